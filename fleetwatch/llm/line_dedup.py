"""Line deduplication with DataFrame functions only.

Documents are split at line feeds. The key of a line is the line without white space (0x09-0x0D, 0x20) at both ends
and with A-Z in lower case. Keys of enough code points that enough documents hold lose all their lines but those of
the document with the smallest id.

1. Lines explode to (document, position, 128-bit hash of the key), and are written to the shared folder.
2. Distinct documents are counted per hash, with the smallest id. Two documents at least is ``min < max``, which is
   combined before the shuffle, so a line that a third of all documents share is one row of each task.
3. Lines look their hash up. Hashes above ``hot_lines`` (of which there can be ``HOT_KEYS`` at most) are broadcast;
   all other lines shuffle by hash, so no key is a large task.
4. The positions that go are gathered per document and cut out of its text.

A document is told by its id and a 128-bit hash of its text, so nothing depends on row numbers. Rows of one id are
one document as to counts and as to who is first; each keeps its own text. Nulls: a null or empty text is one empty line;
a null id is smaller than every other, and rows without one are one document. Repeated rows give the same
result each. Very long texts: what is gathered for one document are positions of its own lines. Empty tables give
empty tables. The input's columns are carried in a struct, so their names cannot clash with added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.exact_dedup import UPPER, ascii_lower
from fleetwatch.session import cut

SPACE = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
LEAST_DOCS = 2
#: A hash with more lines than this, or than the ``HOT_KEYS``-th part of all lines, is joined by a broadcast.
HOT_LINES = 5_000
HOT_KEYS = 100_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashes(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits as two 64-bit hashes with different seeds."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, text: str, key: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, t1, t2, position, h1, h2) of every line whose key is long enough."""
    rows = docs.select(F.col(key).alias("id"), *_hashes(F.coalesce(text, F.lit("")), ("t1", "t2")), F.col(text).alias("x"))
    lines = rows.select("id", "t1", "t2", F.posexplode(_split(F.col("x"))).alias("position", "line"))
    keys = lines.select("id", "t1", "t2", "position", line_key(F.col("line")).alias("line"))
    return keys.where(F.char_length("line") >= least_chars).select(
        "id", "t1", "t2", "position", *_hashes(F.col("line"), ("h1", "h2"))
    )


def repeated_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, first, n) of the keys that so many documents hold: smallest id and number of lines."""
    whole = F.struct("id")  # a struct is never null, so a missing id counts, and comes first
    found = lines.groupBy("h1", "h2").agg(
        F.min(whole).alias("first"),
        F.max(whole).alias("last"),
        F.count(F.lit(1)).alias("n"),
        *([F.count_distinct(whole).alias("documents")] if least_docs > 2 else []),
    )
    enough = F.col("documents") >= least_docs if least_docs > 2 else ~F.col("first.id").eqNullSafe(F.col("last.id"))
    return (found.where(enough) if least_docs > 1 else found).select("h1", "h2", F.col("first.id").alias("first"), "n")


def dropped_positions(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    hot_lines: int = HOT_LINES,
) -> DataFrame:
    """(id, t1, t2, positions) of the documents that lose lines; positions ascend."""
    lines = cut(keyed_lines(docs, text, key, least_chars), "lines")
    limit = max(hot_lines, lines.count() // HOT_KEYS)
    repeated = cut(repeated_keys(lines, least_docs), "line-keys")
    hot = F.broadcast(repeated.where(F.col("n") > limit).drop("n"))
    cold = repeated.where(F.col("n") <= limit).drop("n")
    met = [lines.join(hot, ["h1", "h2"]), lines.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])]
    columns = ["id", "t1", "t2", "position", "first"]
    later = met[0].select(columns).unionByName(met[1].select(columns)).where(~F.col("id").eqNullSafe(F.col("first")))
    return later.groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def _kept(lines: Column, positions: Column) -> Column:
    """The lines between the positions, joined."""
    n = F.size(positions)

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(positions, i - 1) + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(positions, i))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: int) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text) of every row; ``doc`` holds the columns of the input."""
    gone = dropped_positions(docs, text, key, **limits)
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_hashes(whole, ("u1", "u2")))
    same = (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")) & F.col(f"doc.`{key}`").eqNullSafe(F.col("id"))
    lines = _split(F.col(f"doc.`{text}`"))
    return rows.join(gone, same, "left").select(
        "doc",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("positions").isNull(), F.coalesce(F.col(f"doc.`{text}`"), F.lit("")))
        .otherwise(_kept(lines, F.col("positions")))
        .alias("kept_text"),
    )


def line_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: int) -> DataFrame:
    """One row per document: id, lines, dropped lines, digest of the text that is left."""
    return marked(docs.select(key, text), text, key, **limits).select(
        F.col(f"doc.`{key}`").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def without_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: int) -> DataFrame:
    """The documents with their columns, without the lines that an earlier document holds."""
    rows = marked(docs, text, key, **limits)
    return rows.select(*[F.col("kept_text" if c == text else f"doc.`{c}`").alias(c) for c in docs.columns])


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k
  FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= {LEAST_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), judged AS (
  SELECT doc_id, place, line, coalesce(first_id <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
