"""Lenient casts, hashing and tolerance predicates."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetwatch.functions import casts, hashing, scores


def _apply(spark, values, schema, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r["o"] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    values = ["2024-01-05", "2024-1-5", "2024/01/05", " 2024-01-05 ", "2024-01-05 10:00:00", "2024", "2024-01",
              "2024-01-05T10", "2024-02-30", "20240105", "2024-01/05", "inf", "", None]
    got = _apply(spark, values, "string", casts.lenient_date)
    assert [str(g) if g else None for g in got] == ["2024-01-05"] * 5 + [None] * 9


def test_numbers(spark):
    values = ["1", "1.5", ".5", "-2e3", " 7 ", "1d", "1.5f", "1_000", "0x10", "x", "", None]
    assert _apply(spark, values, "string", casts.lenient_double) == [1.0, 1.5, 0.5, -2000.0, 7.0] + [None] * 7


def test_flags(spark):
    values = ["1", "1.0", "0", "2", "1.5", "0.4", "0x1", "yes", "", None]
    assert _apply(spark, values, "string", casts.failure_flag) == [1, 1, 0, 2, 2, 0, 0, 0, 0, 0]
    assert _apply(spark, values, "string", casts.truncated_flag) == [1, 1, 0, 2, 1, 0, 0, 0, 0, 0]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=12), min_size=1, max_size=20), buckets=st.integers(1, 1000))
def test_bucket_is_the_portable_hash(spark, texts, buckets):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    expected = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % buckets for t in texts]
    assert _apply(spark, texts, "string", lambda c: hashing.bucket(c, buckets)) == expected


@pytest.mark.parametrize("fraction, modulus", [(1, 1), (0.4, 2), (0.3, 3), (0.1, 10), (0.01, 100), (0.8, 1)])
def test_modulus(fraction, modulus):
    assert hashing.sample_modulus(fraction) == modulus


@pytest.mark.parametrize("fraction", [0, -0.1, 1.1])
def test_bad_fraction(fraction):
    with pytest.raises(ValueError):
        hashing.sample_modulus(fraction)


def test_tolerance(frame):
    inf, nan = float("inf"), float("nan")
    pairs = [(1.0, 1.0), (1.0, 1.1), (nan, nan), (nan, 1.0), (inf, inf), (inf, -inf), (1.0, inf), (None, None), (None, 1.0)]
    got = frame(pairs, "a double, b double").select(scores.is_close(F.col("a"), F.col("b"), 1e-8, 1e-8)).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False, False, True, False]
    got = frame(pairs[:2] + [(None, 1e-9), (None, 1.0)], "a double, b double")
    far = got.select(scores.off_by_more(F.col("a"), F.col("b"), 1e-8)).collect()
    assert [r[0] for r in far] == [False, True, False, True]


def test_rule_and_clip(frame):
    rows = [(None, None), (3.0, None), (1.0, 8.0)]
    got = frame(rows, "a double, b double").select(scores.rule_score(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [0.0, 1.386294361, 2.197224577]
    clipped = frame([(-1.0,), (0.5,), (2.0,), (None,)], "a double").select(scores.clip01(F.col("a"))).collect()
    assert [r[0] for r in clipped] == [0.0, 0.5, 1.0, None]
