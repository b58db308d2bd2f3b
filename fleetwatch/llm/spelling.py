"""Grouping spelling variants of words with an index of grams of variable length.

1. Words are maximal runs of letters with A-Z in lower case. They are counted over all documents with map-side combine.
   One code point of some occurrences is deleted first, by a hash of id and run, as the contract asks.
2. The dictionary of grams is pruned by frequency in the vocabulary: pairs of characters, and longer grams below the
   frequent ones. Only frequent nodes and the counts of pairs reach the driver. There are at most
   ``NODES`` nodes per length, and at most 8,100 pairs, as there are 90 letters.
3. Each word is decomposed into its grams. From the bound on the grams that one edit affects follows how many lists it must
   merge: its rarest grams, one more than can be affected. Lists are keyed by gram, place and length of word, as a gram
   that an edit leaves alone lies at the same place, or one further on in the longer word. Words so short that an
   edit may change all their grams are also indexed by plain pairs, of which an edit always leaves two; two
   such words meet there.
4. Lists are merged by a join, in which each candidate is verified; only near pairs leave it. AQE splits long lists.
5. The form of a word is its most frequent near word, if twice as frequent; roots follow by doubling the steps.

Nulls: a null text has no words; a null id is an empty text before the colon. Repeated rows count again. Ties: the smallest
word by code points. Very long texts: a row holds its own words. Empty tables give empty tables.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.exact_dedup import UPPER
from fleetwatch.llm.gram_index import LONGEST, SHORTEST, Grams, plain
from fleetwatch.session import cut

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, FACTOR = 5, 3, 2
#: Occurrences whose hash this divides lose a code point.
DELETES = 97
#: A gram is expanded if more than ``FREQUENT`` places of the vocabulary, and more than one in ``NODES``, have it.
FREQUENT, NODES = 64, 10_000
POSTINGS = "level int, gram string, place int, chars int, word string, n long"


def _lower(run: Column) -> Column:
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"), 1)).alias("run"),
    ).where(F.char_length("run") >= LEAST_CHARS)
    lowered = runs.select("id", _lower(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DELETES == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _gram_counts(words: DataFrame, size: int) -> DataFrame:
    places = F.sequence(F.lit(1), F.char_length("word") - size + 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(size)))).alias("gram"))
    return grams.groupBy("gram").count()


def dictionary(words: DataFrame, frequent: int = FREQUENT, nodes: int = NODES, longest: int = LONGEST) -> Grams:
    """Expanded nodes and counts of pairs of a vocabulary."""
    pairs = {r["gram"]: r["count"] for r in _gram_counts(words, SHORTEST).collect()}
    limit = max(frequent, sum(pairs.values()) // nodes)
    expanded = {g for g, n in pairs.items() if n > limit}
    for size in range(SHORTEST + 1, longest):
        counts = _gram_counts(words.where(F.char_length("word") >= size), size).where(F.col("count") > limit)
        expanded |= {r["gram"] for r in counts.collect()}
    return Grams(frozenset(expanded), pairs, longest)


def postings(words: DataFrame, grams: Grams) -> DataFrame:
    """The lists that each word is on, which are the lists to merge for it."""
    pairs = plain(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                found, left = grams.lists(word)
                merged = [(0, g, p) for g, p in found]
                if left < 1:
                    merged += [(1, g, p) for g, p in pairs.lists(word)[0]]
                for level, gram, place in merged:
                    for column, value in zip(rows, (level, gram, place, len(word), word, n)):
                        column.append(value)
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            names = [f.split()[0] for f in POSTINGS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return words.select("word", "n").mapInArrow(run, POSTINGS)


def near_pairs(lists: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all words that are one edit apart, once each."""
    places = [
        F.struct((F.col("chars") + longer).alias("chars"), (F.col("place") + on).alias("place"))
        for longer, on in ((0, 0), (1, 0), (1, 1))
    ]
    probes = lists.select(
        "level", "gram", F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*places)).alias("at")
    ).select("level", "gram", "at.chars", "at.place", "a", "a_n")
    index = lists.withColumnsRenamed({"word": "b", "n": "b_n"})
    keys = ["level", "gram", "chars", "place"]
    verified = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    met = probes.join(index, keys).where(verified & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    there = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    back = pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    best = (
        there.unionByName(back)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    )
    frequent = -F.col("best.less") >= factor * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )


def roots(table: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of its forms.

    Each round doubles the steps. Counts double along a chain, so there are at most 63 steps, and 7 rounds.
    """
    step = cut(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(
            step.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        step = further.drop("moved")
        if further.where("moved").isEmpty():
            return step


def group_variants(
    docs: DataFrame, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT, nodes: int = NODES
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    words = cut(word_counts(docs, text, key), "vocabulary")
    lists = cut(postings(words, dictionary(words, frequent, nodes)), "postings")
    table = cut(forms(words, near_pairs(lists)), "forms")
    found = table.join(roots(table), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
