"""Quality scores by Bradley-Terry ranking of documents.

Labelled rows give preference pairs (a document of label 1 over one of label 0). The logistic loss of the
difference of their features is minimised, so that the linear score of a document is its Bradley-Terry
strength. The cut is the quantile of the strengths of all labelled rows that leaves as many of them above it as
are of label 1; a score of ``THRESHOLD`` is put there.

All labelled rows outside the held-out fold teach, one of each group of copies. They are dealt into blocks of bounded size by
a hash, and each row is in some pairs of its block; rows of a rare label are dealt into several blocks, so none lacks
either. The driver gets one row of sums per block and step. Sums are added in the order of blocks, so they do not depend on partitions.

Nulls and empty texts are documents without words and get the score of such a document. Repeated rows get
equal scores. Without labelled rows of both kinds, every document gets the share of label 1 (0 if there are
none). Labels, language, source and id are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.labelled import known_labels, remainder
from fleetwatch.llm.logistic import loss_sums, newton, sigmoid
from fleetwatch.llm.words import Chunk, WordHasher, chunks, windows, within, words_of
from fleetwatch.operators.ranking import exact_quantiles
from fleetwatch.session import cut

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Rows of a block, pairs per row, and rows of the rarer label that a block gets on average, at least, where there are so many.
BLOCK_ROWS, PAIRS_PER_ROW, LEAST_RARE = 8_000, 5, 100
RIDGE = 3.0
_CLASSES = ("upper", "lower", "digit", "space", "line", "stop", "mark", "symbol", "bar", "high")
FEATURES = 30


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _CLASSES.index("symbol"), np.int8)
    kinds[65:91] = _CLASSES.index("upper")
    kinds[97:123] = _CLASSES.index("lower")
    kinds[48:58] = _CLASSES.index("digit")
    kinds[[9, 11, 12, 13, 32]] = _CLASSES.index("space")
    kinds[10] = _CLASSES.index("line")
    kinds[[ord(c) for c in ".?"]] = _CLASSES.index("stop")
    kinds[[ord(c) for c in ",;:'\"()-"]] = _CLASSES.index("mark")
    kinds[ord("|")] = _CLASSES.index("bar")
    kinds[128:] = _CLASSES.index("high")
    return kinds


_KINDS = _byte_classes()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values from each bound to the next."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(chunk: Chunk, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """One row of features per text of a chunk (shares of character classes, word shapes, repetition), and its sketch.

    The sketch is the smallest hash of three words in a row, of fewer words the sum of theirs.
    """
    kinds, words = _KINDS[chunk.data], words_of(chunk)
    n_bytes = np.diff(chunk.offsets).astype(float)
    size = np.maximum(1.0, n_bytes)
    counts = {name: _sums(kinds == i, chunk.offsets) for i, name in enumerate(_CLASSES)}
    n_words = np.diff(words.bounds).astype(float)
    some = np.maximum(1.0, n_words)
    length = (words.end - words.start).astype(float)
    mean = _sums(length, words.bounds) / some
    spread = np.sqrt(np.maximum(0.0, _sums(length**2, words.bounds) / some - mean**2))
    hashes = hasher(chunk.data, words.start, words.end)
    order = np.lexsort((hashes, words.text))
    fresh = np.ones(len(order))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    distinct = _sums(fresh, words.bounds)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    shouted = np.zeros(len(hashes))
    odd_end = np.zeros(len(hashes))
    if len(hashes):
        upper = np.concatenate([[0], np.cumsum(kinds == _CLASSES.index("upper"))])
        lower = np.concatenate([[0], np.cumsum(kinds == _CLASSES.index("lower"))])
        shouted = ((upper[words.end] - upper[words.start]) >= 2) & (lower[words.end] == lower[words.start])
        odd_end = np.isin(kinds[words.end - 1], [_CLASSES.index("symbol"), _CLASSES.index("bar")])
    share = {name: counts[name] / size for name in counts}
    lines = counts["line"] + 1
    columns = [
        np.log1p(n_words),
        np.minimum(n_words, 50) / 50,
        mean / 10,
        spread / 10,
        distinct / some,
        np.sqrt(distinct) / np.sqrt(some),
        np.log1p(distinct) / np.log1p(some),
        _sums(again, words.bounds) / some,
        _sums(shouted, words.bounds) / some,
        _sums(odd_end, words.bounds) / some,
        np.minimum(1.0, n_words / lines / 60),
        counts["stop"] / some,
        counts["mark"] / some,
        counts["upper"] / np.maximum(1.0, counts["upper"] + counts["lower"]),
        *(share[name] for name in _CLASSES),
        *(np.sqrt(share[name]) for name in ("digit", "symbol", "bar", "mark")),
        (n_words == 0).astype(float),
        np.sqrt(_sums(again, words.bounds) / some),
    ]
    least = np.add.reduceat(np.append(hashes, np.uint64(0)), words.bounds[:-1]) * (n_words > 0)
    runs = within(words.text, 3)
    np.minimum.at(first := np.full(len(least), 2**64 - 1, np.uint64), words.text[: len(runs)][runs], windows(hashes, 3)[runs])
    return np.column_stack(columns), np.where(n_words >= 3, first, least).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, least, f): sketch and features of every document, stored; the texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            found = [features(c, hasher) for c in chunks(batch.column("text"))]
            table = np.concatenate([f for f, _ in found]) if found else np.zeros((0, FEATURES))
            least = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
            values = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(least), values], names=["doc_id", "least", "f"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, least long, f array<double>"), "described")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def preference_pairs(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (better, worse): every row of either label in as many pairs as the other rows of its label."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    n = min(most, len(good) * len(bad))
    repeat = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    return repeat(good), repeat(bad)


#: Runs a step ``(x, y, own) -> sums`` on every block of teaching rows; ``own`` is False for rows that another block counts.
Each = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


class Ranking:
    """Strength of a document: weights of standardised features; ``cut`` is the strength at the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        own = np.ones(len(y), bool)
        self.fit(lambda step: [step(x, y, own)], lambda share: float(np.quantile(self.strengths(x), share)))

    @classmethod
    def learned(cls, each: Each, quantile: Callable[[Ranking, float], float]) -> Ranking:
        made = cls.__new__(cls)
        made.fit(each, lambda share: quantile(made, share))
        return made

    def fit(self, each: Each, quantile: Callable[[float], float]) -> None:
        total = lambda step, size: sum(each(step), np.zeros(size))
        n, ones, *sums = total(lambda x, y, own: np.concatenate([[own.sum(), y[own].sum()], x[own].sum(0)]), 2 + FEATURES)
        self.rate = float(ones / n) if n else 0.0
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.cut = np.zeros(FEATURES), 0.0
        if not 0 < self.rate < 1:
            return
        self.mean = mean = np.array(sums) / n
        spread = np.sqrt(total(lambda x, y, own: ((x[own] - mean) ** 2).sum(0), FEATURES) / n)
        self.scale = scale = np.where(spread > 1e-9, spread, 1.0)

        def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def step(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
                better, worse = preference_pairs(y, PAIRS_PER_ROW * len(y))
                gap = (x[better] - x[worse]) / scale
                slope, curve = loss_sums(gap, np.ones(len(gap)), w)
                return np.concatenate([slope, curve.ravel()])

            found = total(step, FEATURES + FEATURES**2)
            return found[:FEATURES], found[FEATURES:].reshape(FEATURES, FEATURES)

        self.weights = newton(at, np.full(FEATURES, RIDGE))
        self.cut = quantile(1 - self.rate)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not 0 < self.rate < 1:
            return np.full(len(x), self.rate)
        return sigmoid(self.strengths(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def teaching(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, f, label) of all labelled rows outside the held-out fold, stored, one of each group of copies.

    Copies share their sketch, near copies mostly do. Left in, one document with many copies would weigh too much. The row with
    the smallest (hash of the id, id) of a group stays; of rows that repeat an id, that with the smallest features.
    """
    first = F.min_by(F.struct("doc_id", "f"), F.struct(F.xxhash64("doc_id"), "doc_id", "f"))
    rows = found.join(known_labels(labels, "quality", FOLDS, HELD_OUT), "doc_id")
    return cut(rows.groupBy("least", "label").agg(first.alias("row")).select("row.doc_id", "row.f", "label"), "teaching")


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, least_rare: int = LEAST_RARE) -> DataFrame:
    """(block, x, y, own): the teaching rows of each block as matrices, stored."""
    counts = dict(rows.groupBy("label").count().collect())
    n = max(1, -(-sum(counts.values()) // block_rows))
    rare = min(counts, key=lambda v: (counts[v], v), default=0)
    times = min(n, max(1, -(-least_rare * n // max(1, counts.get(rare, 0)))))
    copy = F.sequence(F.lit(0), F.when(F.col("label") == rare, times - 1).otherwise(0))
    dealt = rows.withColumn("copy", F.explode(copy)).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "f") + F.col("copy"), F.lit(n)).cast("int")
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.assign(values=group["f"].map(tuple)).sort_values(["doc_id", "values"])
        x = np.stack(ordered["f"].to_numpy()).astype(float)
        y, own = ordered["label"].to_numpy(float), (ordered["copy"] == 0).to_numpy()
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], **{k: [v.tobytes()] for k, v in (("x", x), ("y", y), ("own", own))}})

    return cut(dealt.groupBy("block").applyInPandas(pack, "block int, x binary, y binary, own binary"), "blocks")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(len(batch)):
        block, x, y, own = (c[i].as_py() for c in batch.columns)
        yield block, np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y), np.frombuffer(own, bool)


def learn(found: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> Ranking:
    """Ranking from all labelled rows outside the held-out fold; ``found`` is the table of ``described``."""
    packed = blocks(teaching(found, labels), block_rows)

    def each(step: Callable) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, x, y, own in _unpacked(batch):
                    sums = np.asarray(step(x, y, own), float).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums])], names=["block", "sums"])

        sums = packed.mapInArrow(run, "block int, sums binary").collect()
        return [np.frombuffer(r["sums"]) for r in sorted(sums, key=lambda r: r["block"])]

    def quantile(ranking: Ranking, share: float) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, x, _, own in _unpacked(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(ranking.strengths(x[own]))], names=["strength"])

        return exact_quantiles(packed.mapInArrow(run, "strength double"), "strength", [share], block_rows)[0]

    return Ranking.learned(each, quantile)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the texts are read once and not shuffled."""
    found = described(docs)
    ranking = learn(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = ranking.scores(_matrix(batch.column("f")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = found.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
