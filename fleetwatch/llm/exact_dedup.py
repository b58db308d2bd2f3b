"""Exact deduplication by a two-pass Bloom filter, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Pass one counts the filter's slots that
two or more rows set; pass two looks every row up in the filter. Only rows that may be repeated are
shuffled by their digest, all others pass straight through.

Nulls: a null text is an empty text. A null id is smaller than every other id. Repeated rows (same id and
text): one of them stays. Empty tables give empty tables. Columns that the operator adds are dropped or
returned under its own names; the input's other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITMAP_BITS = 32768  # of one value of bitmap_construct_agg
BITS_PER_ROW = 16
#: The filter is broadcast; it never exceeds 2**28 bits, which is 32 MB. Beyond that more rows are looked
#: at twice, and the result is the same.
MAX_BITS = 2**28
MAYBE = "__maybe"
_SHA, _ROW = "__sha", "__row"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null as empty."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.when(plain, F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text), 256)


def filter_bits(rows: int) -> int:
    """Bits for so many rows: a power of two between one bitmap and ``MAX_BITS``."""
    return min(MAX_BITS, max(BITMAP_BITS, 1 << max(1, rows * BITS_PER_ROW - 1).bit_length()))


def _slots(digest: Column, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))


def _bitmaps(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the slots that are set."""
    return slots.groupBy((F.col("slot") / BITMAP_BITS).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap")
    )


def repeated_filter(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass one: the filter's slots that at least two rows set.

    Slots are counted with map-side combine, so a key that many rows share is one row of each task.
    """
    slots = rows.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot")).groupBy("slot").count()
    return _bitmaps(slots.where(F.col("count") > 1))


def member_filter(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter's slots that any row sets."""
    return _bitmaps(rows.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot")))


def with_maybe(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass two: ``__maybe`` is false only for rows whose key is surely not in the filter."""
    out = rows
    found = F.lit(True)
    for i, slot in enumerate(_slots(F.col(key), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__b{i}"), F.col("bitmap").alias(f"__m{i}")))
        out = out.join(side, (slot / BITMAP_BITS).cast("int") == F.col(f"__b{i}"), "left")
        place = slot % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"__m{i}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2
        found = found & F.coalesce(bit == 1, F.lit(False))
    return out.withColumn(MAYBE, found).drop("__b0", "__m0", "__b1", "__m1")


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: id, id of the copy that stays (the largest), group size, kept, digest."""
    table = cut(
        docs.select(F.col(key).alias("doc_id"), text_digest(F.col(text)).alias("text_sha256")).withColumn(
            _ROW, F.monotonically_increasing_id()
        ),
        "digests",
    )
    bits = filter_bits(table.count())
    rows = with_maybe(table, "text_sha256", repeated_filter(table, "text_sha256", bits), bits)
    maybe = rows.where(MAYBE)
    groups = maybe.groupBy(F.col("text_sha256").alias(_SHA)).agg(
        F.max(F.struct("doc_id", _ROW)).alias("__top"), F.count(F.lit(1)).alias("group_size")
    )
    looked_up = maybe.join(groups, F.col("text_sha256") == F.col(_SHA)).select(
        "doc_id",
        F.col("__top.doc_id").alias("keep_id"),
        "group_size",
        (F.col(_ROW) == F.col(f"__top.{_ROW}")).alias("kept"),
        "text_sha256",
    )
    alone = rows.where(~F.col(MAYBE)).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(looked_up)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with their columns; rows that cannot be repeated are not shuffled.

    The row that stays is fetched by (digest, id), so a text with many copies spreads over all tasks.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(F.col(key).alias("id"), text_digest(F.col(text)).alias("sha"), whole)
    table = cut(keyed.select("id", "sha"), "digests")
    bits = filter_bits(table.count())
    repeated = repeated_filter(table, "sha", bits)
    keep = (
        with_maybe(table, "sha", repeated, bits)
        .where(MAYBE)
        .groupBy(F.col("sha").alias("keep_sha"))
        .agg(F.max("id").alias("keep_id"))
        .select("keep_sha", F.coalesce("keep_id", F.lit(0)).alias("keep_id"), F.isnull("keep_id").alias("keep_null"))
    )
    rows = with_maybe(keyed, "sha", repeated, bits)
    stay = (
        rows.where(MAYBE)
        .select("sha", F.coalesce("id", F.lit(0)).alias("id"), F.isnull("id").alias("null"), "doc")
        .join(
            keep,
            (F.col("sha") == F.col("keep_sha")) & (F.col("id") == F.col("keep_id")) & (F.col("null") == F.col("keep_null")),
        )
        .dropDuplicates(["sha", "id", "null"])
    )
    return rows.where(~F.col(MAYBE)).select("doc").unionByName(stay.select("doc")).select("doc.*")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
