"""Jaccard join of word shingles with adaptive multi-match prefixes.

A document is the set of its shingles of ``WORDS`` words. All sets are ordered alike, rare shingles first. If two
sets of ``n`` and ``m`` shingles overlap enough, their prefixes of ``n - ceil(0.75 n) + k`` shingles share at least
``k`` of them. Each document chooses its own ``k`` by the estimated cost of its candidates: the more frequent its
prefix, the longer the prefix and the more shared shingles are asked for. Two documents are candidates when they
share as many as the smaller ``k`` of both; candidates are verified on their whole sets.

Documents of equal sets are one class, and only one document of a class is joined. Classes first meet the most
central document of each list of a shingle, so a group of near copies costs as many comparisons as it has members;
what these links connect is not compared again. Then entries of a list that are not connected meet: pair by pair
in short lists; in long ones those not connected with the leader meet all others inside tasks of bounded size.

Nulls and texts without words are empty and linked with nothing, as are rows without an id. Rows that repeat an id
are one document as to links, also with different texts. Rows that repeat id and text give repeated rows. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.llm.components import components
from fleetwatch.llm.exact_dedup import MAYBE, filter_bits, member_filter, with_maybe
from fleetwatch.llm.words import Chunk, WordHasher, chunks, mix, tidy, windows, words_of
from fleetwatch.session import cut

WORDS, PERCENT = 5, 75
MOST_MATCHES = 4  # shared prefix shingles that a document may ask for
VERIFY_COST = 20.0  # of one candidate, in entries of a list
#: Frequencies are kept in so many slots of one byte, whatever the input. They only order the shingles.
SLOTS, SLICE = 2**24, 2**12
LEAST_COUNT = 3
TOGETHER = 2**20  # shingles that a worker sums up before they are shuffled
TOGETHER_BYTES = 4 << 20  # of texts whose sets are compared at a time
SHORT = 32  # entries of a list whose pairs are written out; longer lists are compared in squares
SQUARE = 512
OFTEN = 12  # log2 of the documents from which a list is summed up before it is joined


def shingle_sets(chunk: Chunk, hasher: WordHasher, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a chunk, in order of text and hash, and where each text begins."""
    w = words_of(chunk)
    hashes = hasher(chunk.data, w.start, w.end)
    runs = windows(hashes, size)
    inside = w.text[: len(runs)] == w.text[size - 1 : size - 1 + len(runs)]
    counts = np.diff(w.bounds)
    values, text = [runs[inside]], [w.text[: len(runs)][inside]]
    for few in range(1, size):  # the whole text is the one shingle
        short = np.flatnonzero(counts == few)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(few):
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + hashes[w.bounds[short] + j] + np.uint64(few))
            values.append(own)
            text.append(short)
    value, of = np.concatenate(values), np.concatenate(text)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(chunk.offsets)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _keys(chunk: Chunk, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and both keys of the set of each text."""
    value, bounds = shingle_sets(chunk, hasher)
    key1 = mix(_sums(value, bounds)).view(np.int64)
    key2 = mix(_sums(mix(value + np.uint64(0x632BE59BD9B4E019)), bounds)).view(np.int64)
    return np.diff(bounds).astype(np.int64), key1, key2


def profile(docs: DataFrame) -> DataFrame:
    """Size and key of each document's set: (id, n, key1, key2). Equal sets have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            found = [_keys(chunk, hasher) for chunk in chunks(batch.column("text"))]
            if found:
                columns = [batch.column("id"), *(pa.array(np.concatenate(c)) for c in zip(*found))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key1", "key2"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, n long, key1 long, key2 long")


def packed_counts(value: np.ndarray) -> pa.RecordBatch:
    """(slice, gaps, counts): how often each shingle occurs in ``value``, a row for each slice of the slots.

    A shingle is known by 48 bits of its hash, its slot and the 24 highest; in order, 32 bits hold the gap to the one
    before unless there are few.
    """
    key = np.sort(((value & np.uint64(SLOTS - 1)) << np.uint64(24)) | (value >> np.uint64(40)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    count = np.diff(np.append(first, len(key))).astype(np.uint32)
    key = key[first]
    part = (key >> np.uint64(36)).astype(np.int32)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    gap = np.diff(key, prepend=np.uint64(0))
    gap[begin] = key[begin] & np.uint64(2**36 - 1)
    if len(gap) and int(gap.max()) < 2**32:
        gap = gap.astype(np.uint32)

    def binary(x: np.ndarray) -> pa.Array:
        offsets = (np.append(begin, len(x)) * x.itemsize).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(x)])

    return pa.RecordBatch.from_arrays(
        [pa.array(part[begin], pa.int32()), binary(gap), binary(count)], names=["slice", "gaps", "counts"]
    )


def slice_levels(rows: pa.Table) -> np.ndarray:
    """Levels of the slots of one slice, from its rows of ``packed_counts``."""
    keys, counts = [], []
    for gaps, count in zip(rows.column("gaps").to_pylist(), rows.column("counts").to_pylist()):
        counts.append(np.frombuffer(count, np.uint32))
        kind = np.uint32 if len(gaps) == len(count) else np.uint64
        keys.append(np.cumsum(np.frombuffer(gaps, kind), dtype=np.uint64))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.add.reduceat(count, first, dtype=np.int64)
    often = total >= LEAST_COUNT
    own = np.zeros(SLICE, np.uint8)
    np.maximum.at(own, (key[first[often]] >> np.uint64(24)).astype(np.int64), np.log2(total[often]).astype(np.uint8))
    return own


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each slot of shingles log2 of the documents that hold its most frequent shingle; 0 below ``LEAST_COUNT``.

    Counts cover every shingle of every set. Workers sum up their shingles before the shuffle; what reaches the driver is
    ``SLOTS`` bytes at any size of input, deflated.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(lower=True), [], 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                held.append(shingle_sets(chunk, hasher)[0])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield packed_counts(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield packed_counts(np.concatenate(held))

    def fill(rows: pa.Table) -> pa.Table:
        own = slice_levels(rows)
        found = [zlib.compress(own, 1)] if own.any() else []
        part = rows.column("slice").slice(0, len(found)).combine_chunks()
        return pa.table({"slice": part, "levels": pa.array(found, pa.binary())})

    packed = docs.select("text").mapInArrow(tidy(count), "slice int, gaps binary, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in packed.groupBy("slice").applyInArrow(fill, "slice int, levels binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out


def required(n: np.ndarray | Column):
    """Least number of shared shingles with any linked set, for a set of ``n``: 75 % of it, rounded up."""
    return -(-(n * PERCENT) // 100)


def chosen_matches(frequency: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set (its shingles in order) the number of shared prefix shingles that costs least."""
    n = np.diff(bounds)
    total = np.concatenate([[0.0], np.cumsum(frequency, dtype=np.float64)])
    best, cheapest = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for k in range(1, MOST_MATCHES + 1):
        length = np.minimum(n, n - required(n) + k)
        entries = total[bounds[:-1] + length] - total[bounds[:-1]]
        cost = entries + VERIFY_COST * (entries - length) / k
        better = (cost < cheapest) & (required(n) >= k)
        best[better], cheapest[better] = k, cost[better]
    return best


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, id, mark) of every prefix entry; ``mark`` packs set size, position, matches asked for, frequent.

    The levels are sent to the tasks deflated: most slots are 0.
    """
    packed = zlib.compress(levels, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = WordHasher(lower=True), np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                value, bounds = shingle_sets(chunk, hasher)
                n = np.diff(bounds)
                of = np.repeat(np.arange(len(n)), n)
                level = levels[(value & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((value, level, of))
                value, level = value[order], level[order]
                k = chosen_matches(np.exp2(level), bounds)
                length = np.minimum(n, n - required(n) + k)
                place = np.arange(len(value)) - np.repeat(bounds[:-1], n)
                take = place < length[of]
                mark = (n[of] << 32) | (place << 3) | ((k[of] - 1) << 1) | (level >= OFTEN)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[take].view(np.int64)),
                        pa.array(ids[chunk.first + of[take]].astype(np.int64)),
                        pa.array(mark[take].astype(np.int64)),
                    ],
                    names=["token", "id", "mark"],
                )
            pa.default_memory_pool().release_unused()

    return docs.select("id", "text").mapInArrow(tidy(run), "token long, id long, mark long")


def _size(mark: Column) -> Column:
    return F.shiftright(mark, 32)


def _place(mark: Column) -> Column:
    return F.shiftright(mark, 3).bitwiseAND(2**29 - 1)


def _matches(mark: Column) -> Column:
    return F.shiftright(mark, 1).bitwiseAND(3) + 1


def _may_link(one: Column, two: Column) -> Column:
    """Whether a shared shingle at these places leaves room for the overlap that two linked sets need."""
    sizes = _size(one) + _size(two)
    overlap = F.ceil(sizes * PERCENT / (100 + PERCENT)) - F.least(_matches(one), _matches(two)) + 1
    return (_size(one) - _place(one) >= overlap) & (_size(two) - _place(two) >= overlap)


def posting_lists(entries: DataFrame) -> DataFrame:
    """Entries whose shingle is in two prefixes at least, with the leader of the list: (.., lead, lead_mark).

    The leader has the shingle earliest in its order, so few shingles of its own come before. Entries of rare
    shingles shuffle once; as every shingle is counted, such a list has less than 2 ** ``OFTEN`` documents. Lists of
    frequent ones are summed up on the map side and joined, which Spark splits.
    """
    lead = F.struct(_place(F.col("mark")).alias("place"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    often = F.col("mark").bitwiseAND(1) == 1
    own = Window.partitionBy("token")
    rare = (
        entries.where(~often)
        .withColumn("n", F.count(F.lit(1)).over(own))
        .withColumn("lead", F.min(lead).over(own))
        .where(F.col("n") > 1)
        .select("token", "id", "mark", F.col("lead.id").alias("lead"), F.col("lead.mark").alias("lead_mark"))
    )
    heads = (
        entries.where(often)
        .groupBy(F.col("token").alias("__t"))
        .agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    frequent = entries.where(often).join(heads, F.col("token") == F.col("__t"))
    return rare.unionByName(
        frequent.select("token", "id", "mark", F.col("lead.id").alias("lead"), F.col("lead.mark").alias("lead_mark"))
    )


def _shared(met: DataFrame) -> DataFrame:
    """(a, b, shared, asked) of pairs a < b, from rows (a, b, mark_a, mark_b) per shared shingle."""
    return (
        met.where((F.col("a") != F.col("b")) & _may_link(F.col("mark_a"), F.col("mark_b")))
        .select(
            F.least("a", "b").alias("a"),
            F.greatest("a", "b").alias("b"),
            F.least(_matches(F.col("mark_a")), _matches(F.col("mark_b"))).alias("asked"),
        )
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("asked").alias("asked"))
    )


def _looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with ``MAYBE``, false where their id is surely not among the keys.

    The filter is stored: rows that are read several times would each time bring the plan that makes it.
    """
    bits = filter_bits(keys.count())
    return with_maybe(rows, "id", cut(member_filter(keys, key, bits), "filter"), bits)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id may be among ``ids``: the others are not shuffled for the join that follows."""
    return _looked_up(docs, ids, "id").where(MAYBE).drop(MAYBE)


def slices(batch: pa.RecordBatch, names: tuple[str, ...], most: int = TOGETHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have at most so many bytes together, or one row with longer ones."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy().astype(np.int64) for n in names)
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, last - at)
        at = last


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole sets overlap enough."""
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    texts = _only(docs, ends)
    one = texts.select(F.col("id").alias("__a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("__b"), F.col("text").alias("text_b"))
    both = pairs.join(two, F.col("b") == F.col("__b")).join(one, F.col("a") == F.col("__a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for part in slices(batch, ("text_a", "text_b")):
                sets = []
                for name in ("text_a", "text_b"):
                    own = []
                    for chunk in chunks(part.column(name)):
                        value, bounds = shingle_sets(chunk, hasher)
                        own.extend(np.split(value, bounds[1:-1]))
                    sets.append(own)
                good = []
                for a, b in zip(*sets):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(100 * common >= PERCENT * (len(a) + len(b) - common) and common > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def linked(classes: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different sets, enough of them to connect all that are connected.

    ``classes`` are rows (id, text), one for each set.
    """
    entries = cut(prefixes(classes, frequency_levels(classes)), "prefixes")
    lists = cut(posting_lists(entries), "lists")
    to_lead = lists.select(F.col("lead").alias("a"), F.col("id").alias("b"), F.col("lead_mark").alias("mark_a"), F.col("mark").alias("mark_b"))
    with_lead = cut(_shared(to_lead), "with_lead")
    enough = F.col("shared") >= F.col("asked")
    first = cut(verified(with_lead.where(enough).select("a", "b"), classes), "links")
    group = components(first)
    named = cut(_with_groups(lists, group), "groups")
    # What the leader links is known. Left are lists whose other entries are not all connected.
    own = Window.partitionBy("token")
    rest = named.where(F.col("id") != F.col("lead"))
    often = F.col("mark").bitwiseAND(1) == 1
    rare = (
        rest.where(~often)
        .withColumn("n", F.count(F.lit(1)).over(own))
        .withColumn("open", F.min("group").over(own) != F.max("group").over(own))
        .where("open")
    )
    heads = (
        rest.where(often)
        .groupBy(F.col("token").alias("__t"))
        .agg(F.count(F.lit(1)).alias("n"), (F.min("group") != F.max("group")).alias("open"))
        .where("open")
    )
    frequent = rest.where(often).join(heads, F.col("token") == F.col("__t"))
    columns = ["token", "id", "mark", "lead", "group", "lead_group", "n"]
    opened = cut(rare.select(columns).unionByName(frequent.select(columns)), "open")
    # A pair may share some shingles where one of both leads, and others where neither does.
    together = (
        _shared(_pairs_of_short_lists(opened))
        .unionByName(with_lead.where(~enough))
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("shared"), F.max("asked").alias("asked"))
    )
    second = verified(cut(together.where(enough).select("a", "b"), "candidates"), classes)
    third = _links_of_long_lists(opened, classes)
    return first.unionByName(second).unionByName(third)


def _with_groups(lists: DataFrame, group: DataFrame) -> DataFrame:
    """Entries with the component of their document and of the leader of their list."""
    own, lead = group.toDF("__i", "__g"), group.toDF("__l", "__h")
    return (
        lists.join(own, F.col("id") == F.col("__i"), "left")
        .join(lead, F.col("lead") == F.col("__l"), "left")
        .select(
            "token",
            "id",
            "mark",
            "lead",
            F.coalesce("__g", "id").alias("group"),
            F.coalesce("__h", "lead").alias("lead_group"),
        )
    )


def _pairs_of_short_lists(opened: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list that are not connected, from lists of at most ``SHORT`` entries."""
    short = opened.where(F.col("n") <= SHORT)
    one = short.select("token", F.col("id").alias("a"), F.col("mark").alias("mark_a"), F.col("group").alias("__g"))
    two = short.select(F.col("token").alias("__t"), F.col("id").alias("b"), F.col("mark").alias("mark_b"), "group")
    return one.join(
        two,
        (F.col("token") == F.col("__t"))
        & (F.col("a") < F.col("b"))
        & (F.col("group") != F.col("__g"))
        & _may_link(F.col("mark_a"), F.col("mark_b")),
    ).select("a", "b", "mark_a", "mark_b")


def _links_of_long_lists(opened: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the documents of longer lists: those not connected with the leader against all others.

    Lists of one leader have much the same entries and are compared as one, in squares of ``SQUARE`` documents by
    ``SQUARE``; a square emits only links that connect what was not connected, so no more than it has documents.
    """
    members = cut(
        opened.where(F.col("n") > SHORT)
        .select("lead", "id", "group", (F.col("group") != F.col("lead_group")).alias("stray"))
        .distinct(),
        "members",
    )
    sizes = (
        members.groupBy(F.col("lead").alias("__lead"))
        .agg(
            F.ceil(F.count(F.lit(1)) / SQUARE).alias("columns"),
            F.ceil(F.count(F.when(F.col("stray"), 1)) / SQUARE).alias("rows"),
        )
        .where("rows > 0")
    )
    placed = members.join(sizes, F.col("lead") == F.col("__lead"))
    at = F.xxhash64("id")
    squares = [
        placed.where(side)
        .withColumn("own", F.pmod(at, F.col(own)))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .select("lead", "id", "group", F.lit(left).alias("left"), *[F.col(c).alias(n) for c, n in names])
        for left, side, own, other, names in (
            (True, F.col("stray"), "rows", "columns", (("own", "row"), ("other", "col"))),
            (False, F.lit(True), "columns", "rows", (("other", "row"), ("own", "col"))),
        )
    ]
    ends = cut(members.select("id").distinct(), "ends")
    texts = cut(
        _only(classes, ends).join(ends.withColumnRenamed("id", "__e"), F.col("id") == F.col("__e"), "left_semi"), "texts"
    )
    held = squares[0].unionByName(squares[1]).join(texts.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"))

    def compare(square: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_square_links(square), columns=["a", "b"], dtype="int64")

    columns = ["lead", "row", "col", "id", "group", "left", "text"]
    return held.select(columns).groupBy("lead", "row", "col").applyInPandas(compare, "a long, b long")


def _square_links(square: pd.DataFrame) -> list[tuple[int, int]]:
    """Links of the left documents with the right ones, as many as connect groups that are not connected yet."""
    hasher, sets = WordHasher(lower=True), []
    for chunk in chunks(pa.array(square["text"], pa.large_string())):
        value, bounds = shingle_sets(chunk, hasher)
        sets.extend(np.split(value, bounds[1:-1]))
    ids, groups = square["id"].to_numpy(), square["group"].to_numpy()
    left = np.flatnonzero(square["left"].to_numpy())
    right = np.flatnonzero(~square["left"].to_numpy())
    if not len(left) or not len(right):
        return []
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            g = root[g]
        return g

    tokens = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    size = np.array([len(sets[j]) for j in right])
    out = []
    for i in left.tolist():
        low, high = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], "right")
        length = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        common = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero((100 * common >= PERCENT * (size + len(sets[i]) - common)) & (common > 0)).tolist():
            one, two = find(int(groups[i])), find(int(groups[right[j]]))
            if one != two:
                root[max(one, two)] = min(one, two)
                out.append((int(ids[i]), int(ids[right[j]])))
    return out


def _by_set(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Both tables with ``doc``, their id, and an ``id`` that stands for one set; and whether ids were replaced.

    Where an id has rows of different sets, a hash of id and set takes its place. Only such rows are read again.
    """
    rows, sets = rows.withColumn("doc", F.col("id")), sets.withColumn("doc", F.col("id"))
    several = cut(
        sets.where(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy(F.col("id").alias("__id"))
        .agg(((F.min("key1") != F.max("key1")) | (F.min("key2") != F.max("key2"))).alias("several"))
        .where("several")
        .select("__id"),
        "several",
    )
    n = several.count()
    if not n:
        return rows, sets, False
    bits = filter_bits(n)
    member = cut(member_filter(several, "__id", bits), "filter")

    def renamed(looked: DataFrame, keyed: DataFrame) -> DataFrame:
        own = F.when(F.col("__id").isNotNull(), F.xxhash64("doc", "key1", "key2")).otherwise(F.col("doc"))
        found = keyed.join(several, F.col("doc") == F.col("__id"), "left").withColumn("id", own)
        rest = looked.where(F.coalesce(~F.col(MAYBE), F.lit(True)))
        return rest.select(columns).unionByName(found.select(columns))

    columns = ["id", "n", "key1", "key2", "doc"]
    looked = with_maybe(sets, "id", member, bits)
    new_sets = renamed(looked, looked.where(MAYBE))
    columns = ["id", "text", "doc"]
    looked = with_maybe(rows, "id", member, bits)
    keyed = _with_keys(looked.where(MAYBE))
    return renamed(looked, keyed), cut(new_sets, "sets"), True


def _with_keys(rows: DataFrame) -> DataFrame:
    """Rows (doc, text) with the keys of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, key1, key2 = _keys(chunk, hasher)
                own = batch.slice(chunk.first, chunk.last - chunk.first)
                columns = [own.column("doc"), own.column("text"), pa.array(key1), pa.array(key2)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", "key1", "key2"])

    return rows.select("doc", "text").mapInArrow(tidy(run), "doc long, text string, key1 long, key2 long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, sets, replaced = _by_set(rows, cut(profile(rows), "sets"))
    known = sets.where(F.col("id").isNotNull() & (F.col("n") > 0))
    heads = cut(known.groupBy("key1", "key2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies")), "classes")
    named = cut(
        known.join(
            heads.select(F.col("key1").alias("__1"), F.col("key2").alias("__2"), "head"),
            (F.col("key1") == F.col("__1")) & (F.col("key2") == F.col("__2")),
        ).select("id", "n", "head", "doc"),
        "named",
    )
    # Only the head of each class is joined; the others are looked up by a filter, not by a shuffle of all texts.
    later = cut(named.where(F.col("id") != F.col("head")).select("id").distinct(), "later")
    looked = _looked_up(rows.where(F.col("id").isNotNull()), later, "id")
    checked = looked.where(MAYBE).join(later.select(F.col("id").alias("__later")), F.col("id") == F.col("__later"), "left_anti")
    classes = looked.where(~F.col(MAYBE)).unionByName(checked).select("id", "text")
    links = linked(classes)
    if replaced:
        same = named.groupBy("doc").agg(F.min("head").alias("__least"))
        one = named.select(F.col("doc").alias("__doc"), "head").join(same, F.col("__doc") == F.col("doc"))
        links = links.unionByName(one.select(F.col("head").alias("a"), F.col("__least").alias("b")))
    group = components(links)
    placed = named.join(group, F.col("head") == F.col("node"), "left").select(
        "doc", "n", F.coalesce("component", "head").alias("component")
    )
    if replaced:  # the smallest id in place of the smallest one that stands for a set
        placed = cut(placed, "placed")
        least = placed.groupBy(F.col("component").alias("__c")).agg(F.min("doc").alias("__least"))
        placed = placed.join(least, F.col("component") == F.col("__c")).select("doc", "n", F.col("__least").alias("component"))
    alone = sets.where(F.col("id").isNull() | (F.col("n") == 0)).select("doc", "n", F.col("doc").alias("component"))
    return placed.unionByName(alone).toDF("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: of each component the one with the smallest id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = cut(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    looked = _looked_up(rows, gone, "gone")
    checked = looked.where(MAYBE).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return looked.where(~F.col(MAYBE)).unionByName(checked).select("doc.*")
