"""Substring deduplication by seed and extend.

A window is ``SPAN`` consecutive words. Seeds are winnowed anchors: of the runs of ``GRAM`` words in a window the
one with the smallest hash, the last of equals. Equal windows have equal anchors at equal places, so every
repeat is seeded.

1. Each anchor carries the stretch of all windows that it stands for, which is the run of windows that chose it.
   Matches are not extended beyond it: the windows there have anchors of their own. Anchors join on their hash. Where whole stretches agree, all windows of the later ones repeat.
2. Of stretches that differ around one anchor, the first of each kind is compared window by window.
3. Windows that repeat an earlier one are merged into maximal repeats, and their words are removed.

Equal stretches of one chunk of documents meet before the shuffle, so a passage that a third of all documents
share is one row of each chunk. Windows are judged on the input. The order is that of the id, then of the start.
Nulls and empty texts have no words. A null id comes before every other id. Rows that repeat an id with
another text are ordered by a hash of the text; rows that repeat id and text are equally early and keep their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.llm.exact_dedup import MAYBE, filter_bits, member_filter, with_maybe
from fleetwatch.llm.words import WordHasher, chunks, mix, tidy, windows, within, words_of
from fleetwatch.session import cut

SPAN, GRAM = 20, 8
CHUNK = 4 << 20
COPIED = 1 << 15  # windows whose anchors are looked for at a time
_PLACE_BITS = 40  # of the start of a window; above them 23 bits of a hash of the text
_NO_ID = -(2**63)
_FLAGS = "id long, place long, n int"
ANCHORS = "anchor long, stretch long, id long, place long, n int, shift int, repeats boolean"


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """id (null as the smallest), the upper bits of all places of the row, text, and more columns."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.shiftleft(F.xxhash64(text).bitwiseAND(2**23 - 1), _PLACE_BITS).alias("row"),
        text.alias("text"),
        *more,
    )


class Stretches:
    """Hashes of runs of words of any length, by prefix sums over the hashes of words."""

    def __init__(self, hashes: np.ndarray, hasher: WordHasher):
        n = len(hashes)
        hasher._grow(n + 1)
        self.unpower = hasher.unpower
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * hasher.power[:n])])

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.unpower[start]
        return mix(value + salt.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def first_of_each(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether a row is among the earliest of its key; rows equal in ``order`` are equally early."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    if not len(by):
        return np.zeros(0, bool)
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    head = by[np.flatnonzero(new)]
    early = np.all([o[by] == o[head][group] for o in order], axis=0)
    out = np.empty(len(by), bool)
    out[by] = early
    return out


def anchors_of(hashes: np.ndarray, text: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(first window, number of windows, anchor position, anchor hash) of each run of windows with one anchor."""
    n = max(0, len(hashes) - span + 1)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    grams, width = windows(hashes, gram), span - gram + 1
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    # The smallest of a view is found in a copy of it, so the copy is bounded.
    back = [seen[i : i + COPIED].argmin(axis=1) for i in range(0, n, COPIED)]
    at = np.arange(n) + width - 1 - np.concatenate(back)
    starts = np.flatnonzero(within(text, span))
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count, at[first], grams[at[first]]


def seed(docs: DataFrame) -> DataFrame:
    """Anchors of all documents; those that an equal stretch of the same chunk precedes are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for chunk in chunks(batch.column("text"), CHUNK):
                w = words_of(chunk)
                hashes = hasher(chunk.data, w.start, w.end)
                start, n, at, anchor = anchors_of(hashes, w.text)
                stretch = Stretches(hashes, hasher)(start, start + n + SPAN - 1, (at - start) * 64 + n)
                doc = w.text[start]
                own, place = ids[chunk.first + doc], rows[chunk.first + doc] + start - w.bounds[doc]
                late = ~first_of_each((anchor, stretch), (own, place))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(stretch.view(np.int64)),
                        pa.array(own),
                        pa.array(place),
                        pa.array(n.astype(np.int32)),
                        pa.array((at - start).astype(np.int32)),
                        pa.array(late),
                    ],
                    names=["anchor", "stretch", "id", "place", "n", "shift", "repeats"],
                )

    return docs.mapInArrow(tidy(run), ANCHORS)


def _compare_windows(docs: DataFrame, differing: DataFrame) -> DataFrame:
    """Windows of stretches that share an anchor and differ: (anchor, window, id, place, repeats)."""
    held = differing.groupBy(F.col("id").alias("__id")).agg(
        F.collect_list(F.struct("place", "n", "shift", "anchor")).alias("held")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            lists = batch.column("held")
            for chunk in chunks(batch.column("text"), CHUNK):
                w = words_of(chunk)
                hashes = hasher(chunk.data, w.start, w.end)
                part = lists.slice(chunk.first, chunk.last - chunk.first)
                doc = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                items = part.flatten()
                place, n, shift, anchor = (items.field(i).to_numpy() for i in range(4))
                # Of rows that repeat an id with another text, each has the places of its own.
                mine = (place >> _PLACE_BITS) == (rows[chunk.first + doc] >> _PLACE_BITS)
                doc, place, n, shift, anchor = (x[mine] for x in (doc, place, n, shift, anchor))
                each = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                start = (place & (2**_PLACE_BITS - 1))[each] + step + w.bounds[doc[each]]
                window = Stretches(hashes, hasher)(start, start + SPAN, shift[each] - step)
                own, at, seeds = ids[chunk.first + doc[each]], place[each] + step, anchor[each]
                late = ~first_of_each((seeds, window), (own, at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seeds),
                        pa.array(window.view(np.int64)),
                        pa.array(own.astype(np.int64)),
                        pa.array(at.astype(np.int64)),
                        pa.array(late),
                    ],
                    names=["anchor", "window", "id", "place", "repeats"],
                )

    wanted = _only_of(docs, held, "__id").join(held, F.col("id") == F.col("__id"))
    return wanted.select("id", "row", "text", "held").mapInArrow(
        tidy(run), "anchor long, window long, id long, place long, repeats boolean"
    )


def _only_of(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The documents whose id may be among the keys: the others are not shuffled for the join."""
    table = cut(keys.select(F.col(key).alias("id")), "ids")
    bits = filter_bits(table.count())
    return with_maybe(docs, "id", member_filter(table, "id", bits), bits).where(MAYBE).drop(MAYBE)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, place, n): runs of ``n`` windows from ``place`` on, each of which repeats an earlier window."""
    seeds = cut(seed(docs), "anchors")
    earliest = F.rank().over(Window.partitionBy("anchor", "stretch").orderBy("id", "place"))
    least, most = (f("stretch").over(Window.partitionBy("anchor")) for f in (F.min, F.max))
    met = cut(
        seeds.where(~F.col("repeats"))
        .withColumn("late", earliest > 1)
        .withColumn("differs", least != most)
        .where(F.col("late") | F.col("differs"))
        .select("anchor", "id", "place", "n", "shift", "late"),
        "stretches",
    )
    compared = cut(_compare_windows(docs, met.where(~F.col("late"))), "windows")
    again = F.rank().over(Window.partitionBy("anchor", "window").orderBy("id", "place")) > 1
    one = F.lit(1).alias("n")
    return (
        seeds.where("repeats")
        .select("id", "place", "n")
        .unionByName(met.where("late").select("id", "place", "n"))
        .unionByName(compared.where("repeats").select("id", "place", one))
        .unionByName(
            compared.where(~F.col("repeats")).withColumn("again", again).where("again").select("id", "place", one)
        )
    )


def _covered(flags: list[dict], row: int, n_words: int) -> np.ndarray:
    """Whether each word lies in a repeated window of this row."""
    mine = [(f["place"] & (2**_PLACE_BITS - 1), f["n"]) for f in flags if f["place"] >> _PLACE_BITS == row >> _PLACE_BITS]
    edges = np.zeros(n_words + 1, np.int64)
    if mine:
        start, n = np.array(mine).T
        np.add.at(edges, start, 1)
        np.add.at(edges, start + n + SPAN - 1, -1)
    return np.cumsum(edges)[:n_words] > 0


def maximal_repeats(covered: np.ndarray) -> list[tuple[int, int]]:
    """(first word, number of words) of each run of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def _judged(rows: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have repeats, with their ``flags``, and rows that have none; only the former are shuffled."""
    flags = cut(
        repeated_windows(judged)
        .groupBy("id")
        .agg(F.collect_list(F.struct("place", "n")).alias("flags"))
        .withColumnRenamed("id", "__id"),
        "repeats",
    )
    bits = filter_bits(flags.count())
    looked = with_maybe(rows, "id", member_filter(flags, "__id", bits), bits)
    hit = looked.where(MAYBE).join(flags, F.col("id") == F.col("__id"), "left").drop(MAYBE, "__id")
    return hit, looked.where(~F.col(MAYBE)).drop(MAYBE)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 and the maximal repeats of every document."""
    rows = _numbered(docs)
    hit, clear = _judged(rows, rows)
    clear = clear.withColumn("flags", F.lit(None).cast(hit.schema["flags"].dataType))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("kept_text", pa.string()),
            ("repeats", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, kept, spans = _kept(r["text"], r["flags"], r["row"])
                whole = b" ".join(kept)
                out.append(
                    {
                        "doc_id": None if r["id"] == _NO_ID else r["id"],
                        "n_words": len(words),
                        "n_removed": len(words) - len(kept),
                        "kept_sha256": hashlib.sha256(whole).hexdigest(),
                        "kept_text": whole.decode(),
                        "repeats": [{"first": a, "n": n} for a, n in spans],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    result = (
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
        "repeats array<struct<first: long, n: long>>"
    )
    both = hit.select("id", "row", "text", "flags").unionByName(clear.select("id", "row", "text", "flags"))
    return both.mapInArrow(tidy(run), result)


def _kept(text: str, flags, row: int) -> tuple[list[bytes], list[bytes], list[tuple[int, int]]]:
    """All words, the words that are kept, and the repeats that are removed."""
    words = text.encode().split()
    if flags is None or not len(flags):
        return words, words, []
    covered = _covered(flags, row, len(words))
    return words, list(compress(words, (~covered).tolist())), maximal_repeats(covered)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns; where words are removed, ``text`` and ``n_chars`` are those of what is kept.

    Texts without repeats stay as they are, white space included, and are not shuffled.
    """
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.isnull("text").alias("__null")).alias("own")
    hit, clear = _judged(_numbered(docs, own), _numbered(docs))

    @F.pandas_udf("string")
    def shortened(texts: pd.Series, flags: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for text, found, row in zip(texts, flags, rows):
            words, kept, _ = _kept(text, found, row)
            out.append(b" ".join(kept).decode() if len(kept) < len(words) else None)
        return pd.Series(out, dtype=object)

    before = F.when(~F.col("own.__null"), F.col("text"))
    new = {"text": F.coalesce("short", before)}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("short").isNotNull(), F.char_length("short").cast(kind)).otherwise(
            F.col("own.n_chars")
        )
    both = hit.withColumn("short", shortened("text", "flags", "row")).drop("flags")
    both = both.unionByName(clear.withColumn("short", F.lit(None).cast("string")))
    return both.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in columns])
