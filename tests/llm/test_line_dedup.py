"""Line dedup against brute force: nulls, ties, repeated rows, hot lines, long texts, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string"
SPACE = line_dedup.SPACE
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def key(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def expected(rows, least_chars=10, least_docs=2):
    holders = defaultdict(set)
    order = lambda i: (i is not None, i or 0)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if len(holders.get(key(x), ())) < least_docs or min(holders[key(x)], key=order) == doc_id
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(seed: int = 5, n: int = 90):
    rng = random.Random(seed)
    pool = [f"line number {i} É" for i in range(30)] + ["short", "", "  \t", "ten chars!", "Ten Chars! ", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ"]
    rows = []
    for i in range(n):
        lines = rng.choices(pool, k=rng.randrange(1, 9)) + [f"own line of document {i}"] * rng.randrange(3)
        if i % 3 == 0:
            lines.append("\x0b A licence line that a third of all share \r")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en"))
    rows += [(n, None, None), (n + 1, "", "en"), (n + 2, "\n\n", "en"), (n + 3, "tail line here\n", "en"), (n + 4, "TAIL LINE HERE", "en")]
    rows += [rows[7], rows[7], (8, "another text of eight\nline number 3 É", "en")]
    rows += [(None, "line number 1 É\nonly without id", "en"), (None, "only without id\nline number 29 É", "en")]
    rows += [(n + 5, "\n".join(f"long text line {j % 20_000}" for j in range(30_000)), "en"), (n + 6, "long text line 5\nx", "en")]
    return rows


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("hot_lines", [0, 5, 5_000])
def test_lines_equal_brute_force(spark, hot_lines):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = line_dedup.line_counts(docs, hot_lines=hot_lines).collect()
    want = [(i, n, d, digest(t)) for i, n, d, t in expected(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["n_dropped"] for r in got) > 100


@pytest.mark.parametrize("limits", [{"least_docs": 3}, {"least_docs": 4, "least_chars": 3}, {"least_chars": 1}])
def test_other_limits(spark, limits):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.without_repeated_lines(docs, **limits)
    want = [(i, t) for i, _, _, t in expected(rows, **limits)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == docs.columns


def test_columns_of_the_same_names_are_kept(spark):
    names = ["id", "doc", "t1", "u2", "h1", "positions", "position", "line", "n", "first", "x", "kept_text"]
    rows = corpus(2, 20)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(names)))}
    assert got.count() == len(rows)
    want = {(i, n, d, digest(t)) for i, n, d, t in expected(rows)}
    assert {tuple(r) for r in line_dedup.line_counts(docs).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_counts(docs).collect() == []
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns


def test_no_python_workers_in_the_plan(spark, capsys):
    docs = spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a line of some text\\nb").alias("text"))
    line_dedup.line_counts(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" in plan and "Python" not in plan and "Arrow" not in plan
