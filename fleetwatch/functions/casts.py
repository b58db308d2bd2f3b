"""Lenient text casts: bad text becomes NULL, never an error and never a surprise.

Spark and other engines disagree on odd spellings (``2013``, ``1d``, ``1_000``), so each cast is
guarded by a pattern of the spellings that are accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a day and of a number.
DAY_TEXT = r"^\s*\d{4,6}([-/])\d{1,2}\1\d{1,2}(\s+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_date(c: Column | str) -> Column:
    """Text to DATE; anything that is not a calendar day is NULL."""
    text = _col(c).cast("string")
    day = F.translate(F.substring_index(F.trim(text), " ", 1), "/", "-")
    return F.when(text.rlike(DAY_TEXT), day.try_cast("date"))


def lenient_double(c: Column | str) -> Column:
    """Text to DOUBLE; unparseable text is NULL."""
    text = _col(c).cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def failure_flag(c: Column | str) -> Column:
    """Failure flag as an integer; NULL and unparseable count as 0, ``'1.0'`` counts as 1."""
    return F.coalesce(F.round(lenient_double(c)).try_cast("int"), F.lit(0))


def truncated_flag(c: Column | str) -> Column:
    """Failure flag of the strict contract: fractions are cut off, NULL and unparseable count as 0."""
    return F.coalesce(lenient_double(c).try_cast("int"), F.lit(0))


def missing_flag(c: Column | str) -> Column:
    """1 where the value is NULL, else 0."""
    return _col(c).isNull().cast("int")


def to_day(c: Column | str) -> Column:
    """Timestamp (with or without zone), date or text to its calendar day."""
    return F.to_date(_col(c))
