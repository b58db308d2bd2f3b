"""Gradient-boosted trees by second-order histograms, grown level by level by Spark jobs.

* Features are cut at quantiles of the training rows, at most ``bins`` a feature, and stored as one byte each.
* A level is one pass: gradients and hessians are summed per (node, feature, bin) inside each task. Sums of a (node, feature) meet
  in one task, which looks for its best split; the driver gets one row per (node, feature), neither rows nor histograms.
* A leaf is worth ``-G / (H + penalty)`` times the learning rate. A split needs a hessian of ``least_hessian`` on both
  sides; the hessian of a row holds its weight.
* Boosting ends when average precision on the validation rows has not become better for ``patience`` rounds, and
  keeps the rounds up to the best one. Rounds are validated ``BLOCK`` at a time, all in one ranked pass.

Gradients are integers in units of ``1 / scale``, so sums do not depend on partitions, and the trees are the same for any
files and cores. Rows are drawn per round by a portable hash of their key, features by a portable hash of their place.
Margins are stored once per block, so a pass only adds up the trees of its block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import bucket, row_key
from fleetwatch.models.prep import FEATURES
from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.operators.metrics import average_precision
from fleetwatch.operators.ranking import ROWS_PER_RANGE, prefix_sum
from fleetwatch.session import cut

BLOCK = 10
#: Rows of the binned tables per file: some 10 MB. Every pass reads them, so they are not left in scraps.
ROWS_PER_FILE = 100_000
#: Rows of so few files are summed by one task, which then holds whole sums and needs no shuffle.
DIRECT_TASKS = 1
DRAWS = 10_000
LEAF = -1
BINNED = "key string, y double, w double, bins binary, margin double"
SUMS = "node int, feature int, sums binary"
SPLITS = "node int, feature int, gain double, bin int, lg long, lh long, g long, h long"


@dataclass(frozen=True)
class Boosting:
    """Settings. Those of the published study."""

    rounds: int = 180
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.85
    columns: float = 0.85
    least_hessian: float = 10.0
    penalty: float = 2.0
    patience: int = 30
    bins: int = 256


@dataclass(frozen=True)
class Tree:
    """Nodes by place in the heap: the children of ``k`` are ``2k`` and ``2k + 1``, the root is 1.

    ``feature`` is ``LEAF`` for leaves and unused places; rows with ``bin <= cut`` go left. ``value`` is that of leaves,
    ``cover`` the hessian of the training rows of a node.
    """

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, LEAF), np.zeros(size, np.int64), *(np.zeros(size) for _ in range(3)))

    def leaf_of(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        own = np.arange(len(bins))
        for _ in range(depth):
            feature = self.feature[at]
            left = bins[own, np.maximum(feature, 0)] <= self.cut[at]
            at = np.where(feature == LEAF, at, 2 * at + ~left)
        return at

    def nodes(self) -> list[int]:
        """Places in use, the root first."""
        out, todo = [], [1]
        while todo:
            k = todo.pop(0)
            out.append(k)
            if self.feature[k] != LEAF:
                todo += [2 * k, 2 * k + 1]
        return out


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: edges of the bins per feature, the margin before any tree, all trees and how many count."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    best: int
    depth: int
    #: Average precision on the validation rows after each round, where there were any.
    history: list[float] = field(default_factory=list)

    def kept(self) -> list[Tree]:
        return self.trees[: self.best]

    def threshold(self, tree: Tree, node: int) -> float:
        """The largest value of the node's feature that goes left."""
        return float(self.edges[tree.feature[node]][tree.cut[node]])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _add(np.full(len(x), self.base), self.kept(), _binned(x, self.edges), self.depth)

    def probability(self, features: Column) -> Column:
        """Probability of label 1 for a feature vector."""
        shared = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                margin = shared.margins(np.stack(batch.to_numpy())) if len(batch) else np.zeros(0)
                yield pd.Series(_sigmoid(margin))

        return score(vector_to_array(features))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    out = np.zeros(x.shape, np.uint8)
    for i, own in enumerate(edges):
        out[:, i] = np.searchsorted(own, x[:, i], side="left")
    return out


def _add(margin: np.ndarray, trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.leaf_of(bins, depth)]
    return margin


def quantile_edges(prepared: DataFrame, bins: int, rows_per_range: int = ROWS_PER_RANGE) -> list[np.ndarray]:
    """Per place of the vector the values at which a ``bins``-th part of the rows ends, but for the largest value."""
    places = prepared.select(F.posexplode(vector_to_array(FEATURES)).alias("place", "value"))
    counts = places.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sum(counts, "value", ["n"], by=["place"], rows_per_range=rows_per_range).rows
    total = prepared.count()
    part = [F.floor(F.col(c) * bins / F.lit(total)) for c in ("cum_n", "before")]
    ends = ranked.withColumn("before", F.col("cum_n") - F.col("n")).where((part[0] > part[1]) & (F.col("cum_n") < total))
    width = prepared.select(F.size(vector_to_array(FEATURES))).first()[0]
    found: list[list[float]] = [[] for _ in range(width)]
    for r in ends.select("place", "value").collect():
        found[r["place"]].append(r["value"])
    return [np.array(sorted(v), float) for v in found]


def _key(prepared: DataFrame) -> Column:
    """Text key of a row: the entity-day where there is one, else its values."""
    if {ENTITY, "obs_date"} <= set(prepared.columns):
        return row_key()
    return F.concat_ws(":", F.transform(vector_to_array(FEATURES), lambda v: v.cast("string")))


def _bin_table(prepared: DataFrame, edges: list[np.ndarray], weight: Column, base: float, name: str) -> DataFrame:
    """Key, label, weight, bins and margin of every row, stored."""
    rows = prepared.select(
        _key(prepared).alias("key"),
        F.col(LABEL).cast("double").alias("y"),
        weight.cast("double").alias("w"),
        vector_to_array(FEATURES).alias("x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            bins = _binned(flat.reshape(len(batch), len(edges)), edges)
            columns = [*batch.columns[:3], pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(np.full(len(batch), base))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "y", "w", "bins", "margin"])

    files = max(1, -(-prepared.count() // ROWS_PER_FILE))
    return cut(rows.mapInArrow(run, BINNED).repartition(files), name)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    packed = pa.concat_arrays([batch.column("bins")])
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if len(packed) else 0
    return data[start : start + len(packed) * width].reshape(len(packed), width)


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss, in whole units of ``1 / scale``."""
    p = _sigmoid(margin)
    return np.rint(w * (p - y) * scale), np.rint(w * p * (1.0 - p) * scale)


def scale_for(total_weight: float) -> float:
    """The power of two for which no sum of gradients leaves the whole numbers that a double holds exactly."""
    return 2.0 ** math.floor(52 - math.log2(max(total_weight, 1.0)))


def drawn_features(width: int, share: float, seed: int, number: int) -> list[int]:
    """The features of a round: those with the smallest hashes."""
    draws = [(hashlib.md5(f"{seed}:{number}:{i}".encode()).hexdigest()[:8], i) for i in range(width)]
    return sorted(i for _, i in sorted(draws)[: max(1, int(share * width))])


def best_cuts(nodes: np.ndarray, feature: int, sums: np.ndarray, scale: float, chosen: Boosting) -> pa.RecordBatch:
    """Best cut of one feature in each node, from sums (2, nodes, bins) of gradients and hessians; gain -1 where none fits.

    Ties: first bin. Nodes without rows have no row.
    """
    whole = sums.sum(2)
    there = np.flatnonzero(whole[1])
    sums, whole = sums[:, there], whole[:, there]
    left = sums.cumsum(2)
    (lg, rg), (lh, rh) = ((part / scale, (all_ - part) / scale) for part, all_ in zip(left, whole[:, :, None]))
    g, h = whole[:, :, None] / scale
    gain = lg * lg / (lh + chosen.penalty) + rg * rg / (rh + chosen.penalty) - g * g / (h + chosen.penalty)
    gain = np.where((lh >= chosen.least_hessian) & (rh >= chosen.least_hessian) & (gain > 0), gain, -1.0)
    cut_at, own = gain.argmax(1), np.arange(len(there))
    columns = [
        *[pa.array(v.astype(np.int32)) for v in (nodes[there], np.full(len(there), feature))],
        pa.array(gain[own, cut_at]),
        pa.array(cut_at.astype(np.int32)),
        *[pa.array(v.astype(np.int64)) for v in (*left[:, own, cut_at], *whole)],
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SPLITS.split(", ")])


def _level_splits(
    rows: DataFrame,
    block: list[Tree],
    tree: Tree,
    level: int,
    features: list[int],
    sizes: list[int],
    scale: float,
    chosen: Boosting,
    few: bool = False,
) -> pd.DataFrame:
    """Best cut per node of a level and feature, and the sums of its left side and of the node; ``sizes`` holds the bins per feature."""
    first, depth = 1 << level, chosen.depth
    ends = np.cumsum([sizes[f] for f in features])
    starts, span = ends - [sizes[f] for f in features], int(ends[-1])
    nodes = np.arange(first, 2 * first)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(feature, sums of gradients and hessians by node and bin) of all batches."""
        total = np.zeros((2, first * span))
        for batch in batches:
            bins = _matrix(batch, len(sizes))
            y, w, margin = (batch.column(c).to_numpy() for c in ("y", "w", "margin"))
            found = gradients(_add(margin, block, bins, depth), y, w, scale)
            at = tree.leaf_of(bins, level)
            own = at >= first
            place = (((at[own] - first) * span)[:, None] + starts + bins[own][:, features]).ravel()
            for i, v in enumerate(found):
                total[i] += np.bincount(place, np.repeat(v[own], len(features)), total.shape[1])
        whole = total.astype(np.int64).reshape(2, first, span)
        for feature, start, end in zip(features, starts, ends):
            yield feature, whole[:, :, start:end]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for feature, sums in summed(batches):
            yield best_cuts(nodes, feature, sums, scale, chosen)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for feature, sums in summed(batches):
            there = np.flatnonzero(sums[1].any(1))
            columns = [pa.array(v.astype(np.int32)) for v in (nodes[there], np.full(len(there), feature))]
            packed = pa.array([sums[:, i].tobytes() for i in there], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, packed], names=["node", "feature", "sums"])

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, feature = (k.as_py() for k in key)
        sums = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("sums")).reshape(2, 1, -1)
        return pa.Table.from_batches([best_cuts(np.array([node]), feature, sums, scale, chosen)])

    if few:
        return rows.coalesce(1).mapInArrow(split, SPLITS).toArrow().to_pandas()
    return rows.mapInArrow(parts, SUMS).groupBy("node", "feature").applyInArrow(merged, SPLITS).toArrow().to_pandas()


def _best_splits(splits: pd.DataFrame, scale: float) -> dict[int, tuple]:
    """Per node the best split (gain, feature, cut) or None, and the sums of both its sides and of the node.

    Ties: first feature.
    """
    ordered = splits.sort_values(["node", "gain", "feature"], ascending=[True, False, True])
    out = {}
    for r in ordered.groupby("node").head(1).itertuples():
        split = (float(r.gain), int(r.feature), int(r.bin)) if r.gain > 0 else None
        left, right, whole = ((g / scale, h / scale) for g, h in ((r.lg, r.lh), (r.g - r.lg, r.h - r.lh), (r.g, r.h)))
        out[int(r.node)] = (split, left, right, whole)
    return out


def _grow(
    rows: DataFrame, block: list[Tree], features: list[int], sizes: list[int], scale: float, chosen: Boosting, few: bool
) -> Tree:
    """One tree. A node's sums come with its parent's split; one too light to be split needs no pass."""
    tree = Tree.empty(chosen.depth)

    def leaf(node: int, g: float, h: float) -> None:
        tree.cover[node] = h
        tree.value[node] = -g / (h + chosen.penalty) * chosen.rate

    open_nodes = {1}
    for level in range(chosen.depth):
        if not open_nodes:
            break
        found = _best_splits(_level_splits(rows, block, tree, level, features, sizes, scale, chosen, few), scale)
        if level == 0 and 1 in found:
            leaf(1, *found[1][3])
        children = set()
        for node in sorted(open_nodes & set(found)):
            split, *sides, _ = found[node]
            if split is None:
                continue
            tree.gain[node], tree.feature[node], tree.cut[node] = split
            tree.value[node] = 0.0
            for child, (g, h) in zip((2 * node, 2 * node + 1), sides):
                leaf(child, g, h)
                if h >= 2 * chosen.least_hessian:
                    children.add(child)
        open_nodes = children
    return tree


def _validated(held_out: DataFrame, block: list[Tree], width: int, depth: int) -> list[float]:
    """Average precision after each tree of a block."""
    names = [f"after_{i}" for i in range(len(block))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = _matrix(batch, width), batch.column("margin").to_numpy()
            after = []
            for tree in block:
                margin = _add(margin, [tree], bins, depth)
                after.append(pa.array(margin))
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), *after], names=[LABEL, *names])

    scored = held_out.mapInArrow(run, ", ".join([f"{LABEL} int", *[f"{n} double" for n in names]]))
    found = dict(average_precision(scored, {n: n for n in names}).collect())
    return [round(found[n], 12) for n in names]


def _advanced(rows: DataFrame, block: list[Tree], width: int, depth: int, name: str) -> DataFrame:
    """The table with the margins after a block, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _add(batch.column("margin").to_numpy(), block, _matrix(batch, width), depth)
            yield batch.set_column(4, "margin", pa.array(margin))

    return cut(rows.mapInArrow(run, BINNED), name)


def best_round(history: list[float]) -> int:
    """Number of rounds up to the best value, the first of equals."""
    return 1 + max(range(len(history)), key=lambda i: (history[i], -i))


def _worn_out(history: list[float], patience: int) -> bool:
    """Whether some round was ``patience`` rounds after the best one until then."""
    best = 0
    for i, value in enumerate(history):
        if value > history[best]:
            best = i
        if i - best >= patience:
            return True
    return False


def fit_boosted_trees(
    prepared: DataFrame,
    validation: DataFrame | None,
    weight: str,
    seed: int = 42,
    chosen: Boosting | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> BoostedTrees:
    """Grow trees on weighted rows; without validation rows all rounds are grown and kept."""
    chosen = chosen or Boosting()
    if not 2 <= chosen.bins <= 256:
        raise ValueError("a bin is one byte")
    w, y = F.col(weight).cast("double"), F.col(LABEL)
    sums = prepared.agg(F.sum(F.when(y == 1, w)).alias("ones"), F.sum(F.when(y == 0, w)).alias("zeros")).first()
    if not sums["ones"] or not sums["zeros"]:
        raise ValueError("boosting needs weight on both labels")
    base, scale = math.log(sums["ones"] / sums["zeros"]), scale_for(sums["ones"] + sums["zeros"])
    edges = quantile_edges(prepared, chosen.bins, rows_per_range)
    width, sizes = len(edges), [len(e) + 1 for e in edges]
    rows = _bin_table(prepared, edges, w, base, "boosting-rows")
    held_out = validation and _bin_table(validation, edges, F.lit(1.0), base, "boosting-validation")
    few = prepared.count() <= DIRECT_TASKS * ROWS_PER_FILE
    trees, history = [], []
    while len(trees) < chosen.rounds:
        block: list[Tree] = []
        for number in range(len(trees), min(len(trees) + BLOCK, chosen.rounds)):
            key = F.concat_ws(":", "key", F.lit(str(seed)), F.lit(str(number)))
            drawn = rows.where(bucket(key, DRAWS) < int(chosen.rows * DRAWS)) if chosen.rows < 1 else rows
            features = drawn_features(width, chosen.columns, seed, number)
            block.append(_grow(drawn, block, features, sizes, scale, chosen, few))
        trees += block
        if held_out is not None:
            history += _validated(held_out, block, width, chosen.depth)
            if _worn_out(history, chosen.patience):
                break
            held_out = _advanced(held_out, block, width, chosen.depth, "boosting-validation")
        if len(trees) < chosen.rounds:
            rows = _advanced(rows, block, width, chosen.depth, "boosting-rows")
    best = best_round(history) if history else len(trees)
    return BoostedTrees(edges, base, trees, best, chosen.depth, history)


def with_rounds(model: BoostedTrees, rounds: int) -> BoostedTrees:
    """The model after so many of its rounds."""
    return replace(model, best=min(rounds, len(model.trees)))


def node_rows(model: BoostedTrees, trees: int | None = None) -> list[tuple]:
    """(tree, node, feature, threshold, cut, gain, value, cover) of the first trees; leaves have feature -1."""
    out = []
    for number, tree in enumerate(model.trees[:trees]):
        for k in tree.nodes():
            inner = tree.feature[k] != LEAF
            limit = model.threshold(tree, k) if inner else 0.0
            out.append(
                (number, k, int(tree.feature[k]), limit, int(tree.cut[k]), float(tree.gain[k]), float(tree.value[k]), float(tree.cover[k]))
            )
    return out


NODES = "tree int, node int, feature int, threshold double, cut int, gain double, value double, cover double"
EDGES = "feature int, place int, value double"


def save_trees(path: str, model: BoostedTrees) -> None:
    """Write nodes, edges of the bins and the sizes of a model below a path."""
    spark = SparkSession.active()
    spark.createDataFrame(node_rows(model), NODES).coalesce(1).write.parquet(f"{path}/nodes")
    edges = [(f, i, float(v)) for f, own in enumerate(model.edges) for i, v in enumerate(own)]
    spark.createDataFrame(edges, EDGES).coalesce(1).write.parquet(f"{path}/edges")
    sizes = [(model.base, model.best, model.depth, len(model.edges), len(model.trees), model.history)]
    schema = "base double, best int, depth int, width int, trees int, history array<double>"
    spark.createDataFrame(sizes, schema).coalesce(1).write.parquet(f"{path}/sizes")


def load_trees(path: str) -> BoostedTrees:
    """Read back what ``save_trees`` wrote."""
    spark = SparkSession.active()
    sizes = spark.read.parquet(f"{path}/sizes").first()
    edges: list[list[float]] = [[] for _ in range(sizes["width"])]
    for r in spark.read.parquet(f"{path}/edges").orderBy("feature", "place").collect():
        edges[r["feature"]].append(r["value"])
    trees = [Tree.empty(sizes["depth"]) for _ in range(sizes["trees"])]
    for r in spark.read.parquet(f"{path}/nodes").collect():
        tree, k = trees[r["tree"]], r["node"]
        tree.feature[k], tree.cut[k], tree.gain[k] = r["feature"], r["cut"], r["gain"]
        tree.value[k], tree.cover[k] = r["value"], r["cover"]
    return BoostedTrees([np.array(e, float) for e in edges], sizes["base"], trees, sizes["best"], sizes["depth"], list(sizes["history"]))
