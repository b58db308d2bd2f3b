"""Score expressions and tolerance predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_score(a: Column, b: Column) -> Column:
    """Sector-count rule: log of one plus the larger counter, missing counters as 0."""
    return F.log1p(F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))


def clip01(c: Column) -> Column:
    """Limit to [0, 1]; NULL stays NULL."""
    return F.when(c < 0, F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0.0 when the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def off_by_more(a: Column, b: Column, tolerance: float) -> Column:
    """True when two numbers, NULL read as 0, differ by more than the tolerance."""
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) > F.lit(tolerance)


def is_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-8) -> Column:
    """``|a-b| <= atol + rtol*|b|``; equal infinities, NaN with NaN and NULL with NULL match."""
    both_null = a.isNull() & b.isNull()
    finite = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    unbounded = F.abs(b) == F.lit(float("inf"))
    numeric = (
        F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).when(unbounded, a == b).otherwise(finite)
    )
    return both_null | F.coalesce(numeric, F.lit(False))
