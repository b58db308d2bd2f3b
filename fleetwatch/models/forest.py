"""Isolation forest (Liu, Ting and Zhou, 2008) grown and applied by Spark tasks.

Each tree only sees a bounded sample, the rows of the whole fleet with its smallest draws. Rows above a chance fall away
where they lie, so that no task and no driver ever holds more than one tree's sample, whatever the size of the fleet. All draws are portable hashes: of the row's
key and the tree for samples, of the tree and the node for split features and thresholds. So any engine can grow the same
forest from the same rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import HASH_SPACE, row_key
from fleetwatch.models.prep import FEATURES
from fleetwatch.operators.labels import ENTITY
from fleetwatch.session import cut

TREES = 200
ROWS_PER_TREE = 512
# Rows kept per row that a tree needs; a tree that got too few nevertheless makes all draw again.
OVERDRAW = 2.0
#: Copies of a row without a key are numbered in blocks of so many.
COPIES = 10_000
#: A feature with a smaller range, in standard deviations, does not vary: such differences are rounding.
LEAST_RANGE = 1e-9
#: Nodes by place in the heap: the children of ``k`` are ``2k`` and ``2k + 1``, the root is 1; leaves have feature -1.
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"
BATCH_ROWS = 10_000


def average_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Node table of all trees and the number of rows each tree has seen."""

    nodes: DataFrame
    trees: int
    rows_per_tree: int


def _numbered_copies(values: DataFrame, block: int = COPIES) -> DataFrame:
    """(x, copy) of every row, equal rows numbered from 1.

    Equal rows are counted with map-side combine. The numbers of a row that very many share are made block by block, and the
    blocks spread over all tasks.
    """
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    size = F.greatest(F.lit(block), F.ceil(F.sqrt("copies"))).cast("long")
    sized = counts.withColumn("size", size)
    few = sized.where(F.col("copies") <= F.col("size")).withColumn("part", F.lit(0).cast("long"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.col("size"))))
    many = sized.where(F.col("copies") > F.col("size")).select("*", parts.alias("part")).repartition("x", "part")
    first = F.col("part") * F.col("size") + 1
    last = F.least(F.col("copies"), first + F.col("size") - 1)
    return few.unionByName(many).select("x", F.explode(F.sequence(first, last)).alias("copy"))


def _known_rows(prepared: DataFrame) -> DataFrame:
    """(key, x): a row is known by its entity and day, or else by its values and a copy number."""
    x = vector_to_array(FEATURES).alias("x")
    if {ENTITY, "obs_date"} <= set(prepared.columns):
        return prepared.select(row_key().alias("key"), x)
    rows = _numbered_copies(prepared.select(x))
    values = F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))
    return rows.select(F.concat_ws(":", values, F.col("copy").cast("string")).alias("key"), "x")


def _drawn(rows: DataFrame, trees: int, seed: int, chance: float) -> DataFrame:
    """(tree, draw, key, x) of every row and tree whose draw is below a chance.

    Hashes are compared as text first, so only the few that are drawn become numbers.
    """
    text = F.substring(F.md5(F.concat_ws(":", "key", F.lit(str(seed)), F.col("tree").cast("string"))), 1, 8)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    drawn = rows.select("key", "x", numbers).select("tree", text.alias("hash"), "key", "x")
    limit = math.ceil(chance * HASH_SPACE)
    if limit < HASH_SPACE:
        drawn = drawn.where(F.col("hash") < F.lit(f"{limit:08x}"))
    draw = F.conv("hash", 16, 10).cast("bigint") / F.lit(float(HASH_SPACE))
    return drawn.select("tree", draw.alias("draw"), "key", "x")


def tree_samples(
    prepared: DataFrame, trees: int, rows_per_tree: int, seed: int, overdraw: float = OVERDRAW
) -> DataFrame:
    """(tree, draw, key, x), stored: of all rows, those with the smallest draws of each tree.

    Every row draws for every tree, and about ``overdraw`` times the rows a tree needs stay, so the ``rows_per_tree``
    smallest draws of a tree are among them. Should a tree have got too few, all draw again with a larger chance.
    Draws depend on the key of a row alone, so they are the same for any partitions, files and cores.
    """
    n = prepared.count()
    wanted = min(rows_per_tree, n)
    rows = _known_rows(prepared)
    while True:
        chance = overdraw * rows_per_tree / max(1, n)
        samples = cut(_drawn(rows, trees, seed, chance), "forest_samples")
        full = samples.groupBy("tree").count().where(F.col("count") >= wanted).count()
        if full == trees or chance >= 1:
            return samples
        overdraw *= 2


def _hashed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _grow(x: np.ndarray, tree: int, seed: int, limit: int) -> list[tuple]:
    """Nodes ``(tree, node, feature, threshold, path)`` of one tree."""
    nodes: list[tuple] = []
    open_nodes = [(1, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        depth = node.bit_length() - 1
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high - low > LEAST_RANGE)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes.append((tree, node, -1, 0.0, depth + average_path(len(rows))))
            continue
        feature = int(varying[_hashed(f"{seed}:{tree}:{node}:feature") % len(varying)])
        part = _hashed(f"{seed}:{tree}:{node}:threshold") / HASH_SPACE
        threshold = float(low[feature] + part * (high[feature] - low[feature]))
        # Rounding may give the upper end itself, which would leave the right side empty.
        threshold = min(threshold, float(np.nextafter(high[feature], -np.inf)))
        nodes.append((tree, node, feature, threshold, 0.0))
        goes_left = x[rows, feature] <= threshold
        open_nodes += [(2 * node, rows[goes_left]), (2 * node + 1, rows[~goes_left])]
    return nodes


def fit_isolation_forest(
    prepared: DataFrame, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 42
) -> Forest:
    """Grow the trees, one group of at most a few times ``rows_per_tree`` rows each."""
    if trees < 1:
        raise ValueError("trees must be positive")
    n = prepared.limit(rows_per_tree).count()
    if not n:
        raise ValueError("no rows to grow a forest on")
    size = min(rows_per_tree, n)
    limit = forest_depth(size)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        # Equal draws are told apart by the key and the values, whatever order the rows came in.
        by_value = group.assign(values=group["x"].map(tuple)).sort_values(["draw", "key", "values"])
        x = np.stack(by_value.head(size)["x"].to_numpy())
        nodes = _grow(x, int(group["tree"].iloc[0]), seed, limit)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])

    samples = tree_samples(prepared, trees, rows_per_tree, seed)
    nodes = cut(samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA), "forest_nodes")
    return Forest(nodes, trees, size)


def _tables(forest: Forest) -> dict[str, np.ndarray]:
    """Node table as arrays, one heap per tree; at most ``4 * rows_per_tree`` places per tree, so its size is known."""
    nodes = forest.nodes.toPandas()
    size = 2 << forest_depth(forest.rows_per_tree)
    place = nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
    place = place * size + nodes["node"].to_numpy()
    out = {"starts": np.arange(nodes["tree"].nunique()) * size}
    for name, kind in (("feature", np.int64), ("threshold", float), ("path", float)):
        out[name] = np.zeros(len(out["starts"]) * size, kind)
        out[name][place] = nodes[name].to_numpy()
    return out


def forest_depth(rows_per_tree: int) -> int:
    """Levels below the root."""
    return math.ceil(math.log2(max(rows_per_tree, 2)))


def score_isolation(
    prepared: DataFrame, forest: Forest, name: str = "anomaly_score", batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Adds ``2^(-E[path] / c) - 0.5``; higher is stranger, 0 is the usual border."""
    spark = prepared.sparkSession
    tables = spark.sparkContext.broadcast(_tables(forest))
    depth = forest_depth(forest.rows_per_tree)
    # A forest of one-row trees cannot tell anything apart; its scores are all equal.
    scale = average_path(forest.rows_per_tree) or 1.0

    def paths(x: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
        rows = np.arange(len(x))
        path = np.zeros(len(x))
        for start in t["starts"]:
            at = np.ones(len(x), np.int64)
            for _ in range(depth):
                feature = t["feature"][start + at]
                left = x[rows, np.maximum(feature, 0)] <= t["threshold"][start + at]
                at = np.where(feature < 0, at, 2 * at + ~left)
            path += t["path"][start + at]
        return np.power(2.0, -path / len(t["starts"]) / scale) - 0.5

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tables.value
        for batch in batches:
            parts = [batch.iloc[i : i + batch_rows] for i in range(0, len(batch), batch_rows)]
            found = [paths(np.stack(p.to_numpy()), t) for p in parts]
            yield pd.Series(np.concatenate(found) if found else [], dtype=float)

    return prepared.withColumn(name, score(vector_to_array(FEATURES)))


def score_batches(prepared: DataFrame, forest: Forest, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Anomaly predictions; a task holds at most ``batch_rows`` rows at once, whatever the session's batches."""
    scored = score_isolation(prepared, forest, batch_rows=batch_rows)
    return scored.select("obs_date", "serial_number", "failure_date", "will_fail_30d", "anomaly_score")


def walk(prepared: DataFrame, forest: Forest, keys: list[str]) -> DataFrame:
    """(keys, tree, node, path): the leaf of every row in every tree, all rows one level a round.

    Rows meet the node table by joins on (tree, node), so no task needs the whole forest. It is the way for forests that
    are too large to be sent to every task.
    """
    nodes = forest.nodes
    numbers = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    state = prepared.select(*keys, vector_to_array(FEATURES).alias("x"), numbers).withColumn("node", F.lit(1))
    for _ in range(forest_depth(forest.rows_per_tree)):
        here = nodes.select("tree", "node", "feature", "threshold")
        right = (F.get("x", F.col("feature")) > F.col("threshold")).cast("int")
        node = F.when(F.col("feature") < 0, F.col("node")).otherwise(2 * F.col("node") + right)
        state = state.join(here, ["tree", "node"]).select(*keys, "x", "tree", node.alias("node"))
    return state.join(nodes.select("tree", "node", "path"), ["tree", "node"]).select(*keys, "tree", "node", "path")
