"""Joining rows to a per-key table when one key may hold a large share of the rows.

A per-key table comes from an aggregate, so it carries each key's row count. That count decides:

* few keys: broadcast the table, the rows do not move at all;
* many keys, none hot: one shuffle on the key;
* some hot keys: a key is hot above ``hot_rows`` rows, so there are at most ``total / hot_rows`` of
  them. Their lookup rows are broadcast and their data rows stay where they are; all other keys shuffle.

All ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Sizes beyond which another way is taken."""

    broadcast_keys: int = 1_000_000
    hot_rows: int = 1_000_000


DEFAULT_LIMITS = Limits()
SIZE = "n_rows"


@dataclass(frozen=True)
class KeySizes:
    """Size facts of a per-key table."""

    keys: int
    rows: int
    largest: int


def key_sizes(lookup: DataFrame, size: str = SIZE) -> KeySizes:
    """Number of keys, rows behind them, and rows of the largest key."""
    facts = lookup.agg(F.count(F.lit(1)), F.sum(size), F.max(size)).first()
    return KeySizes(facts[0], facts[1] or 0, facts[2] or 0)


def _hot_lookup(lookup: DataFrame, limits: Limits, size: str) -> DataFrame:
    """Lookup rows of the hot keys; there are at most ``total / hot_rows``."""
    return lookup.where(F.col(size) > limits.hot_rows)


def split_hot(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    sizes: KeySizes,
    limits: Limits = DEFAULT_LIMITS,
    size: str = SIZE,
) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot keys or None, all other rows). Every row is in exactly one of them."""
    if sizes.largest <= limits.hot_rows:
        return None, rows
    hot = F.broadcast(_hot_lookup(lookup, limits, size).select(*keys))
    return rows.join(hot, keys, "left_semi"), rows.join(hot, keys, "left_anti")


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    sizes: KeySizes | None = None,
    limits: Limits = DEFAULT_LIMITS,
    size: str = SIZE,
) -> DataFrame:
    """Inner join of ``rows`` to a table with one row per key; the size column is dropped."""
    sizes = sizes or key_sizes(lookup, size)
    values = lookup.drop(size)
    if sizes.keys <= limits.broadcast_keys:
        return rows.join(F.broadcast(values), keys)
    hot_rows, other_rows = split_hot(rows, lookup, keys, sizes, limits, size)
    joined = other_rows.join(values, keys)
    if hot_rows is None:
        return joined
    hot_values = F.broadcast(_hot_lookup(lookup, limits, size).drop(size))
    return joined.unionByName(hot_rows.join(hot_values, keys))
