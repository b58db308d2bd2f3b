"""One portable hash, so that samples are the same on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2**32


def hash32(text: Column) -> Column:
    """First 32 bits of the MD5 of a text, as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket(text: Column, buckets: int | Column) -> Column:
    """Portable bucket number in ``[0, buckets)``."""
    return hash32(text) % (F.lit(buckets) if isinstance(buckets, int) else buckets)


def row_key(entity: str = "serial_number", day: str = "obs_date") -> Column:
    """Text key of one entity-day."""
    return F.concat_ws(":", F.col(entity), F.date_format(F.col(day), "yyyy-MM-dd"))


def sample_modulus(fraction: float) -> int:
    """1-in-``n`` modulus for a sampling fraction (halves round to even)."""
    if not 0 < fraction <= 1:
        raise ValueError("the sampling fraction must be in (0, 1]")
    return max(1, round(1 / fraction))
