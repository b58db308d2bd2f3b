"""Packing of documents into sequences by cutting-stock column generation.

Documents become token ids (an end id after each) and are cut into pieces of one sequence length, the last
piece being what is left. Piece lengths are a histogram; a linear program over patterns (how many pieces of each
histogram bin a sequence holds) is solved by column generation: the dual prices of the bins are a knapsack,
solved by dynamic programming, whose best filling is the next pattern. Rounded patterns are then dealt
out to the pieces by their rank within their bin.

Only the histogram (at most ``BINS`` numbers) and the patterns reach the driver, at any size of input.
Nulls and empty texts are documents of the end id alone. Repeated rows are packed as often as they occur.
Empty tables give empty tables. Every token of a document lies in exactly one piece.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.llm.words import WORKER_MEMORY, hand_back
from fleetwatch.session import cut

LENGTH, WIDTH, END_ID = 4096, 16, 2
BINS = LENGTH // WIDTH
GAP = 1e-3  # of the linear program to its bound
GROUP_ROWS = 100_000  # of pieces that one task ranks
MEMORY = 96 << 20  # bytes of words and ids that a worker keeps, with ``ENTRY`` for each entry itself
ENTRY = 150
CHUNK = 1 << 20  # characters of texts whose new words are learned together
BATCH = 4096  # words that the tokenizer encodes at a time; what it returns is some hundred times their size
# The pattern of the vocabulary, for lower-case words of Latin letters.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}\\s]+")
_LATIN = re.compile("[\x00-\u024f]*")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to str.split() and not to the tokenizer
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _worker(path: str) -> SimpleNamespace:
    """The tokenizer and the word memory of this worker process, kept from task to task."""
    held = sys.modules.setdefault(WORKER_MEMORY, SimpleNamespace(by_path={}))
    if path not in held.by_path:
        # A task has one core; threads of the tokenizer take more CPU time for the same words.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        held.by_path[path] = SimpleNamespace(
            tokenizer=Tokenizer.from_file(path), words={}, runs={}, held=0, old_words={}, old_runs={}
        )
    return held.by_path[path]


def _little_endian(ids: array) -> array:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by parts that the tokenizer never merges with their neighbours.

    Texts of Latin letters are cut into the runs of the tokenizer's pattern, so that a word with a comma or a capital costs nothing
    new; others into words by white space. Each part is encoded once and remembered, up to a bound in bytes. When half of it is
    reached, what was remembered is old; old parts that come again are kept, the others go at the next turn.
    """

    def __init__(self, path: str):
        self.state = _worker(path)
        self.tokenizer = self.state.tokenizer

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), BATCH):
            found = self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)
            out += [_little_endian(array("I", e.ids)).tobytes() for e in found]
        return out

    def _keep(self, memory: dict[str, bytes], entries: dict[str, bytes]) -> None:
        self.state.held += sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY * len(entries)
        memory.update(entries)

    def _learn(self, parts: list[list[str]], memory: dict[str, bytes], old: dict[str, bytes]) -> None:
        """Remember all parts of some texts; old ones are kept as they are."""
        fresh = set(chain.from_iterable(parts)).difference(memory)
        again = {t: old[t] for t in fresh if t in old}
        self._keep(memory, again)
        if new := list(fresh.difference(again)):
            self._keep(memory, dict(zip(new, self._encode(new))))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new parts of all of them are learned together."""
        state = self.state
        if state.held > MEMORY // 2:
            state.old_words, state.old_runs = state.words, state.runs
            state.words, state.runs, state.held = {}, {}, 0
        odd = [any(c in t for c in _SEPARATORS) for t in texts]
        plain = [not o and "<|" not in t and bool(_LATIN.fullmatch(t)) for t, o in zip(texts, odd)]
        parts = [_RUNS.findall(t.lower()) if p else () if o else t.split() for t, o, p in zip(texts, odd, plain)]
        self._learn(list(compress(parts, plain)), state.runs, state.old_runs)
        self._learn(list(compress(parts, map(not_, plain))), state.words, state.old_words)
        run, word = state.runs.__getitem__, state.words.__getitem__
        return [
            self._encode([t])[0] if o else b"".join(map(run if p else word, own))
            for t, o, p, own in zip(texts, odd, plain, parts)
        ]

    def __call__(self, text: str) -> bytes:
        return self.texts([text])[0]


def _chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[list[str]]:
    """Consecutive texts of at most so many characters together, or one longer text; null counts as empty."""
    chunk, size = [], 0
    for text in texts:
        text = text or ""
        if chunk and size + len(text) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: its place in the document, its length and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            encoded = chain.from_iterable(map(encode.texts, _chunks(batch.column("text").to_pylist())))
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoded):
                ids = memoryview(found + end)
                n = len(ids) // 4
                rows.extend(
                    (doc_id, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n)
                    for s in range(0, n, length)
                )
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_filling(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value, and how often it takes each item."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = size <= c
        if fits.any():
            gain = np.where(fits, value + best[np.where(fits, c - size, 0)], -np.inf)
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], take[c] = gain[i], i
    counts, c = np.zeros(len(size), int), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(size[take[c]])
    return float(best[capacity]), counts


def solve_patterns(demand: np.ndarray, size: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, for the least number of sequences (fractional).

    Revised simplex: a new pattern enters while its price exceeds that of a sequence; by Farley's bound the
    optimum is at least the present value divided by that price.
    """
    patterns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ demand
    steps = 0
    while True:
        dual = inverse.sum(axis=0)
        price, column = best_filling(dual, size, capacity)
        if price <= 1 + gap:
            return patterns, used
        direction = inverse @ column
        rows = direction > 1e-9
        if not rows.any():
            return patterns, used
        ratio = np.where(rows, used / np.where(rows, direction, 1.0), np.inf)
        leaves = int(ratio.argmin())
        patterns[:, leaves] = column
        steps += 1
        if steps % 50:
            pivot = inverse[leaves] / direction[leaves]
            inverse = inverse - np.outer(direction, pivot)
            inverse[leaves] = pivot
        else:
            inverse = np.linalg.inv(patterns)
        used = np.maximum(inverse @ demand, 0.0)


def whole_patterns(demand: np.ndarray, size: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each bin) that meet the demand exactly: the rounded program, the rest largest first."""
    if not len(demand):
        return []
    patterns, used = solve_patterns(demand.astype(float), size, capacity)
    left, out = demand.copy(), []
    for j in np.argsort(-used):
        column = patterns[:, j].round().astype(int)
        times = min(int(used[j] + 1e-6), *(left[column > 0] // column[column > 0]))
        if times > 0:
            out.append((times, column))
            left = left - times * column
    order = np.argsort(-size)
    while left.any():
        column, room = np.zeros(len(size), int), capacity
        for i in order:
            n = min(left[i], room // size[i])
            column[i], room = n, room - n * size[i]
        times = int(min(left[column > 0] // column[column > 0]))
        out.append((times, column))
        left = left - times * column
    return out


def _slots(spark, plan: list[tuple[int, np.ndarray]], bins: np.ndarray) -> DataFrame:
    """Which ranks of a bin each pattern takes, and the first sequence of that pattern."""
    rows, sequence, taken = [], 0, dict.fromkeys(bins.tolist(), 0)
    for times, column in plan:
        for b, n in zip(bins.tolist(), column.tolist()):
            if n:
                rows.append((b, taken[b], taken[b] + n * times, n, sequence))
                taken[b] += n * times
        sequence += times
    return spark.createDataFrame(rows, "bin int, low long, high long, each long, first long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    The tokens are made once and stored as pieces; what follows moves rows of a few numbers. A bin is ranked in
    groups whose number grows with the table, so one hot length is spread over many tasks.
    """
    spark = docs.sparkSession
    pieces = cut(
        cut_documents(docs, path, length)
        .withColumn("bin", F.ceil(F.col("length") / width).cast("int"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    histogram = {r["bin"]: r["count"] for r in pieces.groupBy("bin").count().collect()}
    bins = np.array(sorted(histogram), int)
    demand = np.array([histogram[b] for b in bins.tolist()], int)
    plan = whole_patterns(demand, bins, length // width)
    groups = -(-int(demand.sum()) // GROUP_ROWS) or 1
    ranked = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    before = (
        ranked.groupBy("bin", "group")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("bin").orderBy("group")) - F.col("count"))
        .select(F.col("bin").alias("__bin"), F.col("group").alias("__group"), "before")
    )
    place = F.row_number().over(Window.partitionBy("bin", "group").orderBy(F.col("length").desc(), "row"))
    ranked = (
        ranked.withColumn("place", place)
        .join(before, (F.col("bin") == F.col("__bin")) & (F.col("group") == F.col("__group")))
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .drop("__bin", "__group")
    )
    slots = F.broadcast(_slots(spark, plan, bins).withColumnRenamed("bin", "__bin"))
    dealt = ranked.join(
        slots, (F.col("bin") == F.col("__bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rank")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("offset", offset).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
