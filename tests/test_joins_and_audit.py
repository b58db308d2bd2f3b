"""Join checks, copies of a key, and the audit of one run against another."""

from __future__ import annotations

import datetime as dt
import os
from functools import reduce

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import audit, joins, keyed, review

SCHEMA = "obs_date date, serial_number string, model string, will_fail_30d int, risk_x double"
DAY = dt.date(2020, 1, 1)
ROWS = [(DAY, f"D{i}", "M", i % 2, i / 10) for i in range(6)]


def test_one_to_one(frame):
    a, b = frame(ROWS, SCHEMA).drop("risk_x"), frame(ROWS, SCHEMA).select("obs_date", "serial_number", "risk_x")
    assert joins.join_one_to_one(a, b).count() == 6
    with pytest.raises(ValueError, match="unique"):
        joins.join_one_to_one(a, b.unionByName(b.limit(1)))
    with pytest.raises(ValueError, match="partner"):
        joins.join_one_to_one(a, b.where("risk_x > 0"))


def test_restore_cases(frame):
    df = frame(ROWS, SCHEMA)
    cases = frame([("a", DAY, "D1"), ("b", DAY, "D2")], "case_type string, obs_date date, serial_number string")
    assert {r["case_type"]: r["risk_x"] for r in joins.restore_cases(df, cases).collect()} == {"a": 0.1, "b": 0.2}
    with pytest.raises(ValueError, match="no row"):
        joins.restore_cases(df, cases.unionByName(frame([("c", DAY, "D99")], cases.schema)))
    with pytest.raises(ValueError, match="more than one"):
        joins.restore_cases(df.unionByName(df.where("serial_number = 'D1'")), cases)


@pytest.mark.parametrize("limits", [keyed.Limits(), keyed.Limits(1, 5), keyed.Limits(1, 10_000)])
def test_lookup_join_gives_the_same_rows_on_every_way(frame, limits):
    rows = frame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("lost", 3), (None, 4)], "k string, v int")
    lookup = frame([("hot", 50, "H"), ("a", 1, "A"), ("b", 1, "B"), ("other", 1, "O")], "k string, n_rows int, t string")
    got = keyed.join_lookup(rows, lookup, ["k"], limits=limits)
    expected = rows.join(lookup.drop("n_rows"), "k")
    assert sorted(map(str, got.select("k", "v", "t").collect())) == sorted(map(str, expected.select("k", "v", "t").collect()))


def test_copies_of_a_key(frame):
    df = frame([ROWS[0]] * 3 + [ROWS[1]], SCHEMA)
    got = {r["serial_number"]: r["copies"] for r in joins.one_row_per_key(df).collect()}
    assert got == {"D0": 3, "D1": 1}
    assert not any(r["conflict"] for r in joins.one_row_per_key(df).collect())
    for other in ((DAY, "D0", "M", 0, 0.7), (DAY, "D0", None, 0, 0.0)):
        found = joins.one_row_per_key(df.unionByName(frame([other], SCHEMA))).collect()
        assert {r["serial_number"]: (r["copies"], r["conflict"]) for r in found} == {"D0": (4, True), "D1": (1, False)}


def test_copies_that_differ_fail_the_audit(frame):
    a, b = frame(ROWS, SCHEMA), frame([*ROWS, (DAY, "D0", "M", 0, 0.7)], SCHEMA)
    found = audit.compare_predictions(a, b, ["risk_x"]).first()
    assert found["conflicting_keys"] == 1
    failed = {r["item"] for r in audit.audit_values(a, b, 1).where("not match").collect()}
    assert {"conflicting keys", "sample rows"} <= failed
    failed = {r["item"] for r in audit.audit_all_values(a, b).where("not match").collect()}
    assert {"conflicting keys", "rows", "rows of differing buckets"} <= failed
    assert audit.audit_all_values(b, b).where("not match").count() == 0


def test_comparing_predictions(frame):
    a = frame(ROWS, SCHEMA)
    same = audit.compare_predictions(a, a, ["risk_x"]).first()
    assert (same["matched_rows"], same["missing_keys"], same["score_mismatch_rows"]) == (6, 0, 0)
    changed = [(DAY, "D0", "M", 1, 0.0), (DAY, "D1", "M", 1, 0.1 + 1e-6), (DAY, "D9", "M", 0, 0.5), *ROWS[3:]]
    r = audit.compare_predictions(a, frame(changed, SCHEMA), ["risk_x"]).first()
    assert (r["missing_keys"], r["extra_keys"], r["matched_rows"]) == (1, 1, 5)
    assert (r["label_mismatches"], r["score_mismatch_rows"]) == (1, 1)
    assert r["risk_x_max_abs_diff"] == pytest.approx(1e-6)
    # Copies weigh as the pairs a plain join would give, without meeting each other.
    twice = audit.compare_predictions(frame([ROWS[1]] * 4, SCHEMA), frame([ROWS[1]] * 5, SCHEMA), ["risk_x"]).first()
    assert twice["matched_rows"] == 20


def test_many_cases_meet_the_table_by_a_shuffle(frame):
    df = frame(ROWS, SCHEMA)
    cases = df.select("obs_date", "serial_number").withColumn("case_type", F.lit("x"))
    made = joins.restore_cases(df, cases, most_broadcast=1)
    assert made.count() == len(ROWS) and "SortMergeJoin" in made._jdf.queryExecution().toString()


def _checks(a, b):
    return [audit.audit_counts(a, b, "t"), audit.audit_schema(a, b), audit.audit_values(a, b, 1)]


def test_verdict(frame):
    a = frame(ROWS, SCHEMA)
    good = {r["check"]: r["passed"] for r in audit.audit_verdict(*_checks(a, a)).collect()}
    assert set(good.values()) == {True} and "all" in good
    b = frame([*ROWS[:5], (DAY, "D5", "other", 1, 0.5)], SCHEMA)
    bad = {r["check"]: r["passed"] for r in audit.audit_verdict(*_checks(a, b)).collect()}
    assert bad == {"t_rows": True, "feature_schema": True, "feature_values_sample": False, "all": False}
    found = {r["item"]: r["right_value"] for r in audit.audit_values(a, b, 1).where("not match").collect()}
    assert found == {"model": "1"}


def test_empty_sample_does_not_pass(frame):
    a = frame([], SCHEMA)
    rows = audit.audit_values(a, a, 1).where("item = 'sample rows'").collect()
    assert [r["match"] for r in rows] == [False]


def test_schema_order_matters(frame):
    a = frame(ROWS, SCHEMA)
    assert audit.audit_schema(a, a).where("not match").count() == 0
    assert audit.audit_schema(a, a.select(*reversed(a.columns))).where("not match").count() == 4
    longer = audit.audit_schema(a, a.withColumn("more", F.lit(1))).where("not match").collect()
    assert [r["right_value"] for r in longer] == ["more int"]


def test_metric_parity(frame):
    schema = "model string, split string, metric string, value double"
    a = frame([("x", "test", "recall", 0.5), ("x", "test", "lead", None), ("x", "test", "ap", 0.1)], schema)
    b = frame([("x", "test", "recall", 0.5 + 1e-12), ("x", "test", "lead", None), ("x", "test", "ap", 0.2)], schema)
    got = {r["metric"]: r["match"] for r in audit.compare_metrics(a, b).collect()}
    assert got == {"recall": True, "lead": True, "ap": False}
    lost = audit.compare_metrics(a, b.where("metric = 'recall'"))
    assert {r["metric"]: r["match"] for r in lost.collect()} == {"recall": True, "lead": False, "ap": False}


def test_review_reads(frame):
    df = frame([(DAY, "ab.C", "M", 1, 0.3), (DAY, "abxC", "m.", 0, None), (DAY, None, None, 0, 0.9)], SCHEMA)
    assert [r["serial_number"] for r in review.review_filter(df, serial="B.c").collect()] == ["ab.C"]
    assert review.search_reviews(df, ".", sort_by="risk_x").count() == 2
    assert [r["risk_x"] for r in review.search_reviews(df, sort_by="risk_x").collect()] == [0.9, 0.3, None]
    assert [r[0] for r in review.choices(df, "model").collect()] == ["M", "m."]
    summary = review.drive_summary(df.withColumn("failure_date", F.lit(None).cast("date"))).first()
    assert (summary["days"], summary["any_positive"], summary["failure_date"]) == (3, 1, None)


def test_first_known_model_of_a_drive(frame):
    rows = [(DAY, "A", None, 0, 0.1), (DAY + dt.timedelta(2), "A", "late", 0, 0.1), (DAY + dt.timedelta(1), "A", "first", 0, 0.1)]
    history = review.drive_history(frame(rows, SCHEMA), "A").withColumn("failure_date", F.lit(None).cast("date"))
    assert review.drive_summary(history).first()["model"] == "first"


def test_review_set_has_no_repeats(frame):
    rows = [(DAY, f"D{i}", "M", int(i % 5 == 0), i / 100) for i in range(60)]
    made = review.risk_review_set(frame(rows, SCHEMA), "risk_x", negatives=10, alerts=20).collect()
    keys = [r["serial_number"] for r in made]
    assert len(keys) == len(set(keys))
    assert {f"D{i}" for i in range(0, 60, 5)} | {f"D{i}" for i in range(40, 60)} <= set(keys)
    assert [r["risk_x"] for r in made] == sorted((r["risk_x"] for r in made), reverse=True)


def test_titles(frame):
    columns = ["date", "serial_number", "model", "failure", "capacity_bytes"] + [f"smart_{n}_raw" for n in (5, 9, 187, 188, 194, 197, 198)]
    row = reduce(lambda d, c: d.withColumn(c, F.lit(1.0)), columns, frame([(1,)], "one int"))
    assert review.titled_snapshot(row).columns == list(review.SNAPSHOT_TITLES.values())


def test_an_audit_of_two_runs_writes_no_third(spark, monkeypatch):
    from fleetwatch.plans import queries_review
    from fleetwatch.plans.stages import Study

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    saved, save_run = [], queries_review.runs.save_run
    monkeypatch.setattr(queries_review.runs, "save_run", lambda *a, **k: saved.append(a[2]) or save_run(*a, **k))
    verdict = queries_review.audit_runs_same(Study(spark, folder, rounds=7))  # a study of its own
    assert saved == ["one", "again"]
    assert all(r["passed"] for r in verdict.collect())
