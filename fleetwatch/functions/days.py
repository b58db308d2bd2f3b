"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_diff_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``."""
    return F.datediff(end, start)


def day_number(c: Column) -> Column:
    """Days since 1970-01-01; RANGE frames need a number, not a DATE."""
    return F.unix_date(c)


def month_key(c: Column) -> Column:
    """``yyyy-MM`` text of a DATE."""
    return F.date_format(c, "yyyy-MM")


def iso_dates(df: DataFrame) -> DataFrame:
    """Every DATE and TIMESTAMP column as ``yyyy-MM-dd`` text, the form used in exports."""
    timed = {"date", "timestamp", "timestamp_ntz"}
    return df.select(
        [F.date_format(F.col(n), "yyyy-MM-dd").alias(n) if t in timed else F.col(n) for n, t in df.dtypes]
    )
