"""Parquet tables: projection and predicate on read, zstd on write, schema and row count."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from fleetwatch.functions.casts import lenient_date

#: The partition column of tables by day: the typed day, missing where the text is no day.
DAY_OF = "day_of"
HISTORY_BLOCK = 16 << 20  # bytes of a row group: what reading one entity costs at least


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a missing path raises when it is opened."""
    return spark.read.parquet(path)


def read_rows(df: DataFrame, columns: Iterable[str], where: Column | None = None) -> DataFrame:
    """Named columns in the given order without repeats, rows under a predicate."""
    rows = df if where is None else df.where(where)
    return rows.select(*dict.fromkeys(columns))


def write_table(df: DataFrame, path: str, day: str | None = None, mode: str = "errorifexists") -> None:
    """Write zstd Parquet.

    ``day`` sorts each task's rows, without a shuffle, so that date filters can skip row groups.
    """
    ordered = df.sortWithinPartitions(day) if day else df
    ordered.write.mode(mode).option("compression", "zstd").parquet(path)


def write_days(df: DataFrame, path: str, text: str = "date", rebalance: bool = True) -> None:
    """Write zstd Parquet in one folder per typed day.

    ``rebalance`` first gathers the rows of a day into files of the advised size; sources whose tasks hold few days each do not
    need it.
    """
    typed = df.withColumn(DAY_OF, lenient_date(text))
    placed = typed.hint("rebalance", F.col(DAY_OF)) if rebalance else typed
    placed.write.partitionBy(DAY_OF).option("compression", "zstd").parquet(path)


def open_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table by day, with its partition column last; it may be empty."""
    return spark.read.schema(StructType([*schema.fields]).add(DAY_OF, DateType())).parquet(path)


def newest_day(spark: SparkSession, path: str) -> dt.date | None:
    """The newest day of a table by day, from the names of its folders; no file is read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [s.getPath().getName().partition("=")[2] for s in listed if s.isDirectory()]
    days = [dt.date.fromisoformat(n) for n in names if n[:4].isdigit()]
    return max(days, default=None)


def write_histories(df: DataFrame, path: str, entity: str, day: str) -> None:
    """Write zstd Parquet in the order of entity and day, with Bloom filters of the entity.

    Ranges of entities are files, and within them row groups; a filter on one entity reads a few of these.
    """
    ordered = df.repartitionByRange(entity).sortWithinPartitions(entity, day)
    writer = ordered.write.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{entity}", "true")
    writer.option("parquet.block.size", HISTORY_BLOCK).parquet(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def drop_internal(df: DataFrame, *names: str) -> DataFrame:
    """All columns except the named ones."""
    return df.drop(*names)


def feature_columns(columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical model inputs, chosen by name, in table order."""
    names = list(dict.fromkeys(columns))
    numeric = [c for c in names if c == "capacity_bytes" or c.startswith("smart_")]
    return numeric, ["model"] if "model" in names else []
