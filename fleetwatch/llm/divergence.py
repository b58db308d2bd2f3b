"""Audit of how the sources of a language differ in their words.

Terms are runs of letters A-Z and of characters beyond ASCII, with A-Z in lower case. Terms of each chunk of texts are
packed into one or two 64-bit words, radix-sorted and run-counted per (language, source); terms of over 16 bytes are
sorted as bytes, in buckets of their own. The words stay the key of the shuffles that add the counts up.

A language keeps the terms that enough of its documents hold. Each group (language, source), and each language,
gives a kept term ``p = 1 + floor(10^9 (count + 1) / (N + V))``, where ``N`` is its count over kept terms and ``V`` the number
of kept terms. The divergence of ``p`` from ``q`` at a term is ``floor((p - q)^2 / q)``. All of it is integer arithmetic.

Pairs of sources need no dense table of terms. For sources A and B that do not share a term the sum only depends on how often A
has each ``p``, and on the one ``p`` that B gives to all terms it lacks; terms that both have are corrected for in
tasks, over lists of a term's sources, in blocks of bounded size. Only sums per pair are passed on.

A document is a row; repeated rows count as documents each. Null text, language and source count as ''. Groups
without terms are groups: their ``N`` is 0, and they have pairs. A language without kept terms has pairs of value 0.
Ties: by the UTF-8 bytes of the item. Very long texts are chunks of their own. Empty tables give empty tables.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.llm.exact_dedup import UPPER
from fleetwatch.llm.packed_terms import counted
from fleetwatch.llm.words import chunks
from fleetwatch.session import cut

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
CHUNK = 4 << 20
#: Pairs of sources of terms that a task looks at together.
PAIRS = 1 << 20
#: Up to so many groups, their totals are broadcast (some 60 bytes each); beyond it the join is left to Spark.
SMALL_GROUPS = 50_000
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_TERM = ["w0", "w1", "tail"]
COUNTS = "lang string, source string, w0 long, w1 long, tail binary, n long, docs long"


def _groups_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Table]:
    """The number of each row's group, and the groups."""
    table = pa.table({c: pc.fill_null(batch.column(c), "") for c in ("lang", "source")})
    groups = table.group_by(["lang", "source"], use_threads=False).aggregate([])
    codes = [pc.index_in(table[c], pc.unique(table[c])).to_numpy() for c in ("lang", "source")]
    own = [pc.index_in(groups[c], pc.unique(table[c])).to_numpy() for c in ("lang", "source")]
    width = len(pc.unique(table["source"])) + 1
    places = own[0].astype(np.int64) * width + own[1]
    order = np.argsort(places)
    return order[np.searchsorted(places[order], codes[0].astype(np.int64) * width + codes[1])], groups


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in COUNTS.split(", ")]
    for batch in batches:
        if not len(batch):
            continue
        group, groups = _groups_of(batch)
        for chunk in chunks(batch.column("text"), CHUNK):
            for own, w0, w1, tail, n, docs in counted(chunk, _INSIDE, group[chunk.first : chunk.last]):
                key = groups.take(pa.array(own)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.concat_arrays(key[c].chunks) if len(own) else pa.array([], pa.string()) for c in ("lang", "source")],
                        pa.array(w0.view(np.int64)),
                        pa.array(w1.view(np.int64)),
                        pa.nulls(len(own), pa.binary()) if tail is None else pa.array(tail, pa.binary()),
                        pa.array(n.astype(np.int64)),
                        pa.array(docs.astype(np.int64)),
                    ],
                    names=names,
                )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term as w0, w1, tail, occurrences, documents)."""
    rows = docs.select("text", "lang", "source").mapInArrow(_count, COUNTS)
    return rows.groupBy("lang", "source", *_TERM).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of the terms that enough documents of the language hold, with the language's count."""
    term = Window.partitionBy("lang", *_TERM)
    first = F.row_number().over(term.orderBy("source")) == 1
    all_of = counts.select(
        "*", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("lang_n"), first.alias("is_first")
    )
    return all_of.where(F.col("all_docs") >= least_docs).drop("docs", "all_docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, vocabulary, lang_total) of every group that occurs."""
    occurring = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"), F.sum(F.col("is_first").cast("long")).alias("firsts")
    )
    lang = Window.partitionBy("lang")
    filled = occurring.join(sums, ["lang", "source"], "left").na.fill(0)
    return filled.select(
        "lang",
        "source",
        "total",
        "terms",
        F.sum("firsts").over(lang).alias("vocabulary"),
        F.sum("total").over(lang).alias("lang_total"),
    )


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (total + vocabulary))``, exact for any 64-bit counts; unused where both are 0."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, F.greatest(total + vocabulary, F.lit(1)).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(kept: DataFrame, groups: DataFrame, small_groups: int = SMALL_GROUPS) -> DataFrame:
    """Kept counts with the group's share ``p``, its share ``p0`` of a term it lacks, and the language's share ``q``."""
    side = F.broadcast(groups) if groups.count() <= small_groups else groups
    joined = kept.join(side, ["lang", "source"])
    total, vocabulary = F.col("total"), F.col("vocabulary")
    return joined.select(
        "lang",
        "source",
        *_TERM,
        share(F.col("n"), total, vocabulary).alias("p"),
        share(F.lit(0), total, vocabulary).alias("p0"),
        share(F.col("lang_n"), F.col("lang_total"), vocabulary).alias("q"),
    )


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of groups that share terms, what their shared terms add to the sum of the parts."""
    for batch in batches:
        lists = batch.column("holders")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        named = pc.dictionary_encode(flat.field("source"))
        langs = pc.dictionary_encode(batch.column("lang"))
        own = np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64) * len(named.dictionary)
        code = own + named.indices.to_numpy()
        groups, code = np.unique(code, return_inverse=True)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        ends = np.cumsum(size)
        at = 0
        while at < len(code):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = size[at:last]
            a = np.repeat(np.arange(at, last), n)
            b = np.repeat(begin[at:last], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            both = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
            pair = code[a] * len(groups) + code[b]
            order = np.argsort(pair, kind="stable")
            new = np.flatnonzero(np.diff(pair[order], prepend=-1))
            found = pair[order][new]
            left, right = groups[found // len(groups)], groups[found % len(groups)]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(left // len(named.dictionary))),
                    named.dictionary.take(pa.array(left % len(named.dictionary))),
                    named.dictionary.take(pa.array(right % len(named.dictionary))),
                    pa.array(np.add.reduceat(both[order], new)),
                ],
                names=["lang", "source", "item", "value"],
            )
            at = last


def pair_values(groups: DataFrame, p: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every other source of the language."""
    rows = groups.select("lang", "source", "terms", "vocabulary", share(F.lit(0), F.col("total"), F.col("vocabulary")).alias("p0"))
    others = rows.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("q0"))
    different = F.col("source") != F.col("item")
    lacking = F.col("vocabulary") - F.col("terms") - F.col("item_terms")
    pairs = rows.where("vocabulary > 0").join(others, "lang").where(different)
    neither = pairs.select("lang", "source", "item", (lacking * divergence(F.col("p0"), F.col("q0"))).alias("value"))
    empty = rows.where("vocabulary = 0").select("lang", "source").join(others, "lang").where(different)
    none = empty.select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    steps = p.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    own = steps.join(others, "lang").where(different)
    first = own.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * divergence(F.col("p"), F.col("q0"))).alias("value"))
    second = own.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        F.sum(F.col("m") * divergence(F.col("q0"), F.col("p"))).alias("value")
    )
    holders = (
        p.groupBy("lang", *_TERM)
        .agg(F.collect_list(F.struct("source", "p", "p0")).alias("holders"))
        .where(F.size("holders") > 1)
        .select("lang", "holders")
    )
    shared = holders.mapInArrow(_corrections, "lang string, source string, item string, value long").where(different)
    parts = neither.unionByName(none).unionByName(first).unionByName(second).unionByName(shared)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_text() -> Column:
    """The term of ``w0``, ``w1`` and ``tail`` as text."""
    second = F.when(F.col("w1") == 0, F.lit(b"")).otherwise(F.unhex(F.hex("w1")))
    whole = F.concat(F.unhex(F.hex("w0")), second, F.coalesce("tail", F.lit(b"")))
    return F.rtrim(whole.cast("string"), F.lit("\0"))


def _unsigned(word: str) -> Column:
    """A key that orders 64-bit words as unsigned ones."""
    return F.col(word).bitwiseXOR(F.lit(-(2**63)))


def term_values(p: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source uses most above its language."""
    over = p.where("p > q").select("lang", "source", *_TERM, divergence(F.col("p"), F.col("q")).alias("value"))
    order = [F.desc("value"), _unsigned("w0"), _unsigned("w1"), F.asc_nulls_first("tail")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    best = over.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("lang", "source", term_text().alias("item"), "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, small_groups: int = SMALL_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of the parts ``pair`` and ``term``."""
    kept = cut(kept_terms(cut(term_counts(docs), "term-counts"), least_docs), "kept-terms")
    groups = cut(group_totals(docs, kept), "groups")
    p = cut(shares(kept, groups, small_groups), "shares")
    pairs = pair_values(groups, p)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(columns)
        .unionByName(term_values(p, top).withColumn("part", F.lit("term")).select(columns))
    )


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL
), grid AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n,
    1 + ({SCALE} * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p,
    1 + ({SCALE} * (lang_n + 1)) // (sum(lang_n) OVER g + count(*) OVER g) AS q
  FROM grid WINDOW g AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
