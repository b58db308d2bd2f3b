"""Audits by checksums, and the store of runs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import audit, checksums
from fleetwatch.sources import runs, tables
from fleetwatch.sources.reports import METRIC_SCHEMA

DAY = dt.date(2024, 1, 1)
SCHEMA = "obs_date date, serial_number string, a double, b double, t string"


def _rows(n=300):
    return [(DAY + dt.timedelta(days=i % 10), f"D{i // 10}", i / 7, None if i % 5 else float(i), f"t{i % 3}") for i in range(n)]


def _failed(a, b, buckets=None):
    return {r["item"]: (r["left_value"], r["right_value"]) for r in audit.audit_all_values(a, b, buckets).where("not match").collect()}


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_one_changed_value_is_found_in_its_bucket(frame, buckets):
    rows = _rows()
    other = [*rows[:42], (*rows[42][:2], rows[42][2] + 1, *rows[42][3:]), *rows[43:]]
    a, b = frame(rows, SCHEMA), frame(other, SCHEMA).repartition(5)
    assert _failed(a, b, buckets) == {"a": ("0", "1")}
    found = checksums.compare_trees(a, b, ["serial_number", "a", "b", "t"], buckets)
    near = checksums.suspect_rows(a, found).count()
    assert not found.equal and found.rows == (300, 300) and found.leaves.count() == 1
    assert near == 30 if buckets in (None, 1) else 0 < near < 30


def test_equal_tables_are_read_once(frame, monkeypatch):
    """Whatever the order of the rows; no value is read again."""
    monkeypatch.setattr(audit, "suspect_rows", lambda *a: pytest.fail("values read twice"))
    a = frame(_rows(), SCHEMA)
    got = audit.audit_all_values(a, a.orderBy(F.desc("a")).repartition(3)).collect()
    assert all(r["match"] for r in got) and {r["item"] for r in got} >= {"rows", "a", "b", "t"}


def test_only_the_differing_days_are_scanned(spark, frame, tmp_path):
    tables.write_table(frame(_rows(), SCHEMA), str(tmp_path / "a"), "obs_date")
    a = tables.open_table(spark, str(tmp_path / "a"))
    b = a.withColumn("t", F.when((F.col("obs_date") == F.lit(DAY)) & (F.col("serial_number") == "D3"), "x").otherwise(F.col("t")))
    found = checksums.compare_trees(a, b, ["serial_number", "a", "b", "t"], 4)
    plan = checksums.suspect_rows(a, found)._jdf.queryExecution().toString()
    assert "EqualTo(obs_date,2024-01-01)" in plan or "In(obs_date, [2024-01-01])" in plan
    assert _failed(a, b, 4) == {"t": ("0", "1")}


def test_copies_missing_values_and_zeros(frame):
    one = (DAY, "A", 1.0, None, "x")
    a = frame([one, one], SCHEMA)
    assert _failed(a, frame([one], SCHEMA)).keys() == {"rows", "rows of differing buckets"}
    assert _failed(a, frame([one, one], SCHEMA)) == {}
    swapped = frame([(DAY, "A", None, 1.0, "x")] * 2, SCHEMA)
    assert {"a", "b"} <= _failed(a, swapped).keys()
    assert _failed(frame([(DAY, "A", 0.0, None, "x")], SCHEMA), frame([(DAY, "A", -0.0, None, "x")], SCHEMA)) == {}
    no_day = frame([(None, "A", 1.0, None, "x")], SCHEMA)
    assert _failed(no_day, no_day) == {}
    assert "rows of differing buckets" in _failed(no_day, frame([one], SCHEMA))
    moved = frame([(DAY + dt.timedelta(days=1), *one[1:])], SCHEMA)
    assert "rows of differing buckets" in _failed(frame([one], SCHEMA), moved)


def test_empty_tables_and_other_columns(frame):
    empty = frame([], SCHEMA)
    assert _failed(empty, empty).keys() == {"rows"}
    a = frame(_rows(20), SCHEMA)
    assert _failed(a, a.drop("t")) == {"columns": ("3", "2")}


def test_buckets_follow_the_size():
    assert [checksums.bucket_count(n, 30) for n in (0, 1000, 3_000_000, 3_000_001)] == [1, 1, 1, 2]
    assert checksums.bucket_count(10**12, 365) == 27398


def _save(spark, frame, root, name, rows=None):
    metrics = frame([("m", "test", "recall", 0.5)], METRIC_SCHEMA)
    return runs.save_run(spark, root, name, {"features": frame(rows or _rows(40), SCHEMA)}, metrics, {"m": 0.25}, parameters={"h": 3})


def test_a_run_is_read_as_it_was_saved(spark, frame, tmp_path):
    root = str(tmp_path / "runs")
    assert runs.run_ids(spark, root) == []
    _save(spark, frame, root, "b")
    _save(spark, frame, root, "a", _rows(7))
    assert runs.run_ids(spark, root) == ["a", "b"]
    run = runs.open_run(spark, root, "b")
    assert run.rows("features") == run.table("features").count() == 40
    assert run.thresholds == {"m": 0.25} and run.parameters == {"h": 3}
    assert [tuple(r) for r in run.metrics().collect()] == [("m", "test", "recall", 0.5)]
    with pytest.raises(KeyError, match="no table"):
        run.table("labels")
    with pytest.raises(ValueError, match="already"):
        _save(spark, frame, root, "b")


def test_a_run_without_manifest_is_not_there(spark, frame, tmp_path):
    """An attempt that dies leaves no run; the next one does not see its parts."""
    root = str(tmp_path / "runs")
    with pytest.raises(AttributeError):
        runs.save_run(spark, root, "x", {"features": frame(_rows(40), SCHEMA)}, models={"broken": (None, None, [])})
    assert runs.run_ids(spark, root) == []
    with pytest.raises(KeyError, match="no committed run"):
        runs.open_run(spark, root, "x")
    run = _save(spark, frame, root, "x", _rows(9))
    assert run.rows("features") == 9 and len(list((tmp_path / "runs" / "x").iterdir())) == 3
