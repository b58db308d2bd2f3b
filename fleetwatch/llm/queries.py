"""The registered queries of this package, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.llm import ann, bpe, divergence, exact_dedup, html_mincut, line_dedup, ngram_join, packing, quality, spelling
from fleetwatch.llm import substring, warc
from fleetwatch.llm import toxicity as toxic

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_mincut.extract(table(spark, folder, "pages"))


@query(exact_dedup.SQL)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copies(table(spark, folder, "documents"))


@query()
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, folder, "documents"), vocabulary(BYTE_RANKS))


@query()
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(warc.SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, folder, "pages")).drop("url")


@query()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(WORD_VOCABULARY))


@query(divergence.SQL)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query()
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


@query(line_dedup.SQL)
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, folder, "documents"))
