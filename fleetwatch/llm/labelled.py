"""Labelled rows for the classifiers: which may teach, which are held out, and a bounded sample of them for ``toxicity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.session import cut


def remainder(key: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor


def known_labels(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """(doc_id, label) of all labelled rows outside the held-out fold; rows that repeat with different labels are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__other"))
    return (
        one.where(F.col("label") == F.col("__other"))
        .where(remainder(F.col("doc_id"), divisor) != held_out)
        .select("doc_id", "label")
    )


def teaching_rows(labels: DataFrame, label: str, divisor: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` of the known labels, chosen by a hash of the id; small enough to broadcast."""
    return known_labels(labels, label, divisor, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def teaching_docs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the chosen rows; the documents are not shuffled."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")


def distinct_sample(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The chosen rows with their texts, one of each group of copies, as a stored table.

    Copies share the smallest hash of three words in a row, near copies mostly do. Left in, one document with
    many copies would make all of its words look like evidence. The row with the smallest (hash of the id, id) of a
    group stays, so the sample is the same for any partitions; of rows that repeat an id, the smallest text.
    """
    word = F.col("__words")
    smallest = F.array_min(F.transform(word, lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2))))
    first = F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64("doc_id"), "doc_id", "text"))
    return cut(
        teaching_docs(docs, rows)
        .withColumn("__words", F.split(F.lower("text"), r"[^\p{L}]+"))
        .withColumn("__least", smallest)
        .groupBy("__least", "label")
        .agg(first.alias("row"))
        .select("row.doc_id", "row.text", "label"),
        "sample",
    )
