"""The latest reporting day of a fleet, typed for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwatch.functions.casts import failure_flag, lenient_date, lenient_double
from fleetwatch.sources.tables import DAY_OF, newest_day, open_days

# The raw attributes shown for a snapshot.
SNAPSHOT_ATTRIBUTES = (5, 9, 187, 188, 194, 197, 198)


def latest_snapshot(raw: DataFrame) -> DataFrame:
    """Rows of the newest day, twelve typed columns; columns the source lacks are NULL.

    For tables whose day is only a text: the newest day is found by a pass over that column, and the second pass filters the
    parsed text. ``stored_snapshot`` reads one day only.
    """
    newest = raw.agg(F.max(lenient_date("date")).alias("day")).first()["day"]
    return typed_snapshot(raw.where(lenient_date("date") == F.lit(newest)))


def stored_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The same rows of a table by day: the newest day comes from the folders, and only its files are read."""
    return typed_snapshot(open_days(spark, path, schema).where(F.col(DAY_OF) == F.lit(newest_day(spark, path))))


def typed_snapshot(rows: DataFrame) -> DataFrame:
    """The twelve typed columns of a snapshot."""
    have = set(rows.columns)

    def number(name: str):
        value = lenient_double(name) if name in have else F.lit(None).cast("double")
        return value.alias(name)

    return rows.select(
        lenient_date("date").alias("date"),
        "serial_number",
        "model",
        number("capacity_bytes"),
        (failure_flag("failure") != 0).alias("failure"),
        *[number(f"smart_{n}_raw") for n in SNAPSHOT_ATTRIBUTES],
    )
