"""Comparing two tables by checksums, so that value columns are read once where the tables agree.

A table becomes a tree of sums: per (day, hash bucket of the row key) the number of rows and four order-free sums of two
64-bit row hashes; days and the whole table are sums of those. Trees are compared from the top. Only the rows of
buckets that differ are read again and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import bucket, row_key
from fleetwatch.session import cut

DAY, BUCKET = "obs_date", "key_bucket"
SUMS = ("rows", "s0", "s1", "s2", "s3")
#: Buckets per day: a differing bucket costs so many rows to look at again, on average.
ROWS_PER_BUCKET = 100_000
#: Differing days are pushed down to the scan as literals up to this number.
MOST_DAYS = 400


def _parts(df: DataFrame, columns: list[str]) -> list[Column]:
    """What is hashed: every value and whether it is missing; zeros of both signs are equal, and so are all NaNs."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    out = []
    for c in columns:
        value = F.col(f"`{c}`")
        out += [value + F.lit(0.0) if c in doubles else value, value.isNull()]
    return out


def bucket_count(rows: int, days: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // (max(1, days) * rows_per_bucket)))


def key_bucket(buckets: int) -> Column:
    return bucket(F.coalesce(row_key(), F.lit("")), buckets)


def bucket_sums(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """The leaves of the tree: (day, bucket, rows, four sums), combined before the shuffle.

    Sums of 32-bit halves stay exact up to 2^31 rows of one bucket. They count copies, and do not depend on order.
    """
    day = F.col(DAY).cast("date")
    # The day is hashed too: a row that moves to another day must change the sums of the whole table.
    seeds = [[F.lit(i), day, day.isNull(), *_parts(df, columns)] for i in range(2)]
    rows = df.select(day.alias(DAY), key_bucket(buckets).alias(BUCKET), *[F.xxhash64(*p).alias(f"h{i}") for i, p in enumerate(seeds)])
    halves = [F.col(f"h{i}").bitwiseAND(0xFFFFFFFF) if low else F.shiftrightunsigned(f"h{i}", 32) for i in (0, 1) for low in (0, 1)]
    return rows.groupBy(DAY, BUCKET).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)]
    )


def per_day(leaves: DataFrame) -> DataFrame:
    """The level above the leaves; sums may grow beyond 64 bits, so they are decimals."""
    return leaves.groupBy(DAY).agg(*[F.sum(F.col(c).cast("decimal(30,0)")).alias(c) for c in SUMS])


def root(leaves: DataFrame) -> DataFrame:
    """The top of the tree, one row."""
    return leaves.agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(30,0)")), F.lit(0).cast("decimal(30,0)")).alias(c) for c in SUMS])


def differing(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The keys of one level at which the sums differ, or that one side lacks."""
    left = a.select(*on, F.struct(*SUMS).alias("left"))
    right = b.select(*[F.col(c).alias(f"other_{c}") for c in on], F.struct(*SUMS).alias("right"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    both = left.join(right, same, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    return both.select(*[F.coalesce(c, f"other_{c}").alias(c) for c in on])


@dataclass(frozen=True)
class TreeDifference:
    """What two trees say: whether the tables are equal, the rows of each, and the buckets that differ."""

    equal: bool
    rows: tuple[int, int]
    buckets: int
    leaves: DataFrame | None


def compare_trees(a: DataFrame, b: DataFrame, columns: list[str], buckets: int | None = None) -> TreeDifference:
    """Compare two tables by their sums: the roots first, then the days, then the buckets of differing days."""
    if buckets is None:
        size = a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(DAY)).alias("days")).first()
        buckets = bucket_count(size["n"], size["days"])
    sums = [cut(bucket_sums(df, columns, buckets), "checksums") for df in (a, b)]
    roots = [tuple(root(s).first()) for s in sums]
    rows = (int(roots[0][0]), int(roots[1][0]))
    if roots[0] == roots[1]:
        return TreeDifference(True, rows, buckets, None)
    days = differing(per_day(sums[0]), per_day(sums[1]), [DAY])
    near = [s.join(days, s[DAY].eqNullSafe(days[DAY]), "left_semi") for s in sums]
    return TreeDifference(False, rows, buckets, cut(differing(near[0], near[1], [DAY, BUCKET]), "differing"))


def suspect_rows(df: DataFrame, found: TreeDifference, most_days: int = MOST_DAYS) -> DataFrame:
    """The rows of the buckets that differ; few differing days are read as a pushed-down list."""
    days = [r[0] for r in found.leaves.select(DAY).distinct().limit(most_days + 1).collect()]
    rows = df
    if len(days) <= most_days:
        known = F.col(DAY).isin([d for d in days if d is not None])
        rows = df.where(known | F.col(DAY).isNull() if None in days else known)
    leaves = found.leaves.withColumnsRenamed({DAY: "leaf_day", BUCKET: "leaf_bucket"})
    at = F.col(DAY).cast("date").eqNullSafe(F.col("leaf_day")) & (key_bucket(found.buckets) == F.col("leaf_bucket"))
    return rows.join(leaves, at, "left_semi")
