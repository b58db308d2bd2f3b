"""Joins between prediction tables, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.labels import ENTITY
from fleetwatch.session import cut

KEYS = ("obs_date", ENTITY)
BROADCAST_CASES = 10_000


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Left join of two tables with unique keys; every row of ``a`` must find its partner.

    One join holds the rows and the numbers of rows per key on both sides; it is stored, checked and returned, so it is
    not run again.
    """
    copies = ["__copies", "__partners"]
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]) for df in (a, b)]
    sides = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.first(w).alias(f"{n}_row"))
        for df, n, w in zip((a, b), copies, whole)
    ]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = sides[0].alias("l").join(sides[1].alias("r"), same, "full_outer")
    named = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    joined = cut(both.select(*named, *copies, *[f"{n}_row" for n in copies]), "one-to-one")
    most, lone = joined.agg(
        F.max(F.greatest(*copies)), F.count(F.when(F.col("__partners").isNull(), 1))
    ).first()
    if most is not None and most > 1:
        raise ValueError(f"the keys {list(keys)} are not unique on both sides")
    if lone:
        raise ValueError("some rows have no partner")
    columns = [F.col(c) if c in keys else F.col(f"__copies_row.`{c}`").alias(c) for c in a.columns]
    more = [F.col(f"__partners_row.`{c}`").alias(c) for c in b.columns if c not in keys]
    return joined.where(F.col("__copies").isNotNull()).select(*columns, *more)


def restore_cases(
    df: DataFrame, cases: DataFrame, keys: tuple[str, ...] = KEYS, most_broadcast: int = BROADCAST_CASES
) -> DataFrame:
    """Rows of a large table for named cases; every case must be found exactly once.

    Up to ``most_broadcast`` cases are broadcast; more meet the table by a shuffle.
    """
    wanted = cases.select(*keys, *[c for c in cases.columns if c not in df.columns])
    n = wanted.count()
    restored = df.join(F.broadcast(wanted) if n <= most_broadcast else wanted.hint("merge"), list(keys))
    if restored.count() != n:
        raise ValueError("some cases have no row, or more than one")
    return restored


CONFLICT = "conflict"


def one_row_per_key(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Copies of a key as one row with ``copies``; ``conflict`` says whether its rows differ.

    Of rows that differ the smallest one stands for all. Copies are combined before the shuffle, and the shuffle is on
    the keys alone, so that a join on them needs no other.
    """
    values = [c for c in df.columns if c not in keys]
    copies = F.count(F.lit(1)).alias("copies")
    if not values:
        return df.groupBy(*keys).agg(copies).withColumn(CONFLICT, F.lit(False))
    row = F.struct(*values)
    grouped = df.groupBy(*keys).agg(copies, F.min(row).alias("low"), F.max(row).alias("high"))
    return grouped.select(*keys, "low.*", "copies", (~F.col("low").eqNullSafe(F.col("high"))).alias(CONFLICT))


def match_predictions(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer join on (day, entity); ``a_<c>``, ``b_<c>``, how many copies each side has and whether they differ.

    Days are compared as dates. A key found on one side only has NULL copies on the other.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(F.col("obs_date").cast("date").alias("obs_date"), ENTITY, *columns)
        return one_row_per_key(keyed).withColumnsRenamed({c: f"{name}_{c}" for c in [*columns, "copies", CONFLICT]})

    return side(a, "a").join(side(b, "b"), list(KEYS), "full_outer")


def matched(pairs: DataFrame) -> DataFrame:
    """The keys both sides have."""
    return pairs.where(F.col("a_copies").isNotNull() & F.col("b_copies").isNotNull())


def missing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days and entities of ``a`` that ``b`` lacks, with the number of rows behind each."""

    def keys_of(df: DataFrame) -> DataFrame:
        return one_row_per_key(df.select(F.col("obs_date").cast("date").alias("obs_date"), ENTITY))

    return keys_of(a).join(keys_of(b), list(KEYS), "left_anti")
