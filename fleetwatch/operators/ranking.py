"""Running totals over an ordered key, without ever sorting the whole table in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.operators.labels import LABEL
from fleetwatch.session import cut

ROWS_PER_RANGE = 500_000
RANGE = "key_range"


@dataclass(frozen=True)
class Ranked:
    """A table with one row per distinct key and group, its running totals, and each row's range."""

    rows: DataFrame
    key: str
    by: list[str]
    descending: bool
    n_ranges: int


def _range_starts(table: DataFrame, key: str, by: list[str], n_ranges: int) -> list[float]:
    """Inner boundaries that split the keys of every group into ranges of about equal size."""
    if n_ranges < 2:
        return []
    shares = [i / n_ranges for i in range(1, n_ranges)]
    # A range may come out about twice as large as the others; finer sketches would be costly to merge.
    starts = F.percentile_approx(key, shares, max(1_000, 2 * n_ranges)).alias("starts")
    found = table.groupBy(*by).agg(starts).collect()
    # NaN and the infinities lie in the outer ranges anyway.
    return sorted({e for row in found for e in row["starts"] if math.isfinite(e)})


def _with_range(table: DataFrame, key: str, starts: list[float]) -> DataFrame:
    if not starts:
        return table.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *starts, float("inf")]
    # NaN is kept in a range after all others: it is the largest key.
    ranges = Bucketizer(splits=splits, inputCol=key, outputCol=RANGE, handleInvalid="keep")
    placed = ranges.transform(table)
    return placed.withColumn(RANGE, F.col(RANGE).cast("int"))


def _ordered(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def prefix_sum(
    table: DataFrame,
    key: str,
    values: list[str],
    descending: bool = False,
    by: list[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> Ranked:
    """Inclusive running totals ``cum_<value>`` in key order, for each group of ``by``.

    ``table`` has one row per distinct key (group first: ties, however many, are then one row). Keys
    are cut into ranges of bounded size, NaN being the largest key and infinities ordinary ones; each range is summed in its own task, and the totals of the
    ranges before it, a few rows per range, are added from a broadcast.
    """
    by = list(by)
    table = cut(table.withColumn(key, F.col(key).cast("double")).where(F.col(key).isNotNull()), "ranked")
    n_ranges = max(1, -(-table.count() // rows_per_range))
    placed = _with_range(table, key, _range_starts(table, key, by, n_ranges))
    totals = placed.groupBy(*by, RANGE).agg(*[F.sum(v).alias(f"range_{v}") for v in values])
    before = (
        Window.partitionBy(*by)
        .orderBy(_ordered(RANGE, descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *by,
        RANGE,
        *[F.coalesce(F.sum(f"range_{v}").over(before), F.lit(0)).alias(f"before_{v}") for v in values],
    )
    in_range = (
        Window.partitionBy(*by, RANGE)
        .orderBy(_ordered(key, descending))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = placed.select("*", *[F.sum(v).over(in_range).alias(f"inner_{v}") for v in values])
    joined = summed.join(F.broadcast(starts), [*by, RANGE])
    rows = joined.select(
        *table.columns,
        RANGE,
        *[(F.col(f"inner_{v}") + F.col(f"before_{v}")).alias(f"cum_{v}") for v in values],
    )
    return Ranked(rows, key, by, descending, n_ranges)


def next_in_order(ranked: Ranked, value: str, default: Column) -> DataFrame:
    """Adds ``next_<value>``: the value of the next key, also across the border of a range."""
    key, by, descending = ranked.key, ranked.by, ranked.descending
    first = F.max_by(value, key) if descending else F.min_by(value, key)
    heads = ranked.rows.groupBy(*by, RANGE).agg(first.alias("head"))
    after = Window.partitionBy(*by).orderBy(_ordered(RANGE, descending))
    following = heads.select(*by, RANGE, F.lead("head").over(after).alias("head_after"))
    in_range = Window.partitionBy(*by, RANGE).orderBy(_ordered(key, descending))
    inside = ranked.rows.withColumn("inside_next", F.lead(value).over(in_range))
    joined = inside.join(F.broadcast(following), [*by, RANGE])
    return joined.select(
        *ranked.rows.columns,
        F.coalesce("inside_next", "head_after", default).alias(f"next_{value}"),
    )


def score_groups(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Positives and negatives per scorer and distinct score, all scorers in one pass over the rows.

    ``scores`` maps scorer name to score column.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
            for m, c in scores.items()
        ]
    )
    return (
        df.select(LABEL, F.inline(pairs))
        .groupBy("model", "score")
        .agg(
            F.count(F.when(F.col(LABEL) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(LABEL) == 0, 1)).alias("neg"),
        )
    )


def exact_quantiles(
    df: DataFrame, column: str, shares: list[float], rows_per_range: int = ROWS_PER_RANGE
) -> list[float]:
    """Quantiles with linear interpolation, exact on any number of rows.

    Position ``h = (n-1) * share``; the result lies between the values at ``floor(h)`` and ``ceil(h)``.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sum(counts, "value", ["n"], rows_per_range=rows_per_range).rows
    total = ranked.agg(F.max("cum_n").alias("n")).first()["n"]
    if not total:
        return []
    places = [(total - 1) * s for s in shares]
    ranks = sorted({r for h in places for r in (int(h), min(int(h) + 1, total - 1))})
    covers = [
        F.max(F.when((F.col("cum_n") - F.col("n") <= r) & (F.col("cum_n") > r), F.col("value"))).alias(str(r))
        for r in ranks
    ]
    at = ranked.agg(*covers).first()
    low = [at[str(int(h))] for h in places]
    high = [at[str(min(int(h) + 1, total - 1))] for h in places]
    return [a + (b - a) * (h - int(h)) for a, b, h in zip(low, high, places)]
