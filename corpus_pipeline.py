"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``.

A stage lowers the rows of the Arrow batches that the session sends to Python to ``BATCH_ROWS``, and leaves it so: frames are lazy.
With Spark's 10,000 rows the texts of a task are one batch, which an executor holds outside its heap, and each worker once more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.llm import packing, substring, toxicity
from fleetwatch.llm.exact_dedup import exact_dedup
from fleetwatch.llm.ngram_join import one_of_each
from fleetwatch.llm.queries import WORD_VOCABULARY, vocabulary
from fleetwatch.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(_BATCH))
        if not 0 < rows <= BATCH_ROWS:  # 0 or less: no bound
            spark.conf.set(_BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model learns from the labels of this folder."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup(docs)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their shingles the one with the smallest id."""
    return one_of_each(docs)


@_in_small_batches
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document, or an earlier place, has."""
    return substring.without_repeats(docs)


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]
#: The learned and tokenized stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, which cuts the lineage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
