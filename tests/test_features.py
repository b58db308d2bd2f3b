"""As-of features: fixed values, no look-ahead, both execution ways, duplicates."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import features as feat
from fleetwatch.operators.keyed import Limits
from fleetwatch.operators.labels import horizon_labels

RAW = (
    "date string, serial_number string, model string, capacity_bytes string, failure string, smart_5_raw string, "
    "smart_9_raw string, smart_197_raw string, smart_198_raw string, filename string"
)
TINY = Limits(broadcast_keys=1, hot_rows=2)


def _row(day, value, serial="A", failure="0", hours="1", name="f.csv", pending=None):
    return (day, serial, "M", "1000", failure, None if value is None else str(value), hours, pending, None, name)


def _typed(frame, rows, attrs=(5,)):
    return feat.typed_rows(frame(rows, RAW), list(attrs))


def _made(frame, rows, attrs=(5,)):
    typed = _typed(frame, rows, attrs)
    return feat.rolling_features(feat.change_features(typed, list(attrs)), list(attrs))


def _rounded(df):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()),
        key=str,
    )


def test_trailing_values(frame):
    rows = [_row(f"2020-01-0{d}", v) for d, v in enumerate((3, 3, 12, 6), 1)]
    got = {r["date"]: r for r in _made(frame, rows).collect()}
    expected = [(3, 3, 1, 0.0, None), (3, 3, 2, 0.0, 0), (6, 12, 3, math.sqrt(18), 9), (6, 12, 4, math.sqrt(13.5), -6)]
    for d, (mean, top, n, std, change) in enumerate(expected, 1):
        r = got[f"2020-01-0{d}"]
        assert (r["smart_5_mean_7d"], r["smart_5_max_7d"], r["smart_5_count_7d"]) == (mean, top, n)
        assert math.isclose(r["smart_5_std_7d"], std, abs_tol=1e-12)
        assert r["smart_5_change"] == change


def test_the_future_does_not_change_the_past(frame):
    rows = [_row(f"2020-01-0{d}", v) for d, v in enumerate((5, 8, 2, 9), 1)]
    before = {r["date"]: r for r in _made(frame, rows).collect()}
    after = {r["date"]: r for r in _made(frame, [*rows[:3], _row("2020-01-04", 31_000)]).collect()}
    for d in ("2020-01-01", "2020-01-02", "2020-01-03"):
        assert before[d] == after[d]
    assert before["2020-01-04"] != after["2020-01-04"]


def test_change_needs_a_near_previous_row(frame):
    week = {r["date"]: r["smart_5_change"] for r in _made(frame, [_row("2020-01-01", 1), _row("2020-01-08", 5)]).collect()}
    assert week["2020-01-08"] == 4
    longer = {r["date"]: r["smart_5_change"] for r in _made(frame, [_row("2020-01-01", 1), _row("2020-01-09", 5)]).collect()}
    assert longer["2020-01-09"] is None
    rows = [_row("2020-01-01", 1), _row("2020-01-02", None), _row("2020-01-03", 5)]
    gap = {r["date"]: r["smart_5_change"] for r in _made(frame, rows).collect()}
    assert gap == {"2020-01-01": None, "2020-01-02": None, "2020-01-03": None}


def test_window_borders(frame):
    rows = [_row("2020-01-01", 100), _row("2020-01-07", 1), _row("2020-01-08", 2)]
    got = {r["date"]: r for r in _made(frame, rows).collect()}
    assert got["2020-01-07"]["smart_5_count_7d"] == 2
    assert got["2020-01-08"]["smart_5_count_7d"] == 2
    assert got["2020-01-08"]["smart_5_max_7d"] == 2
    assert got["2020-01-08"]["smart_5_max_30d"] == 100


def test_rows_of_one_day_see_each_other(frame):
    rows = [_row("2020-01-01", 1, name="a"), _row("2020-01-01", 3, name="b")]
    got = _made(frame, rows).collect()
    assert {r["smart_5_mean_7d"] for r in got} == {2.0}
    assert {r["smart_5_count_7d"] for r in got} == {2}


def test_no_values_in_a_frame(frame):
    r = _made(frame, [_row("2020-01-01", None)]).first()
    assert (r["smart_5_mean_7d"], r["smart_5_max_7d"], r["smart_5_std_7d"], r["smart_5_count_7d"]) == (None, None, None, 0)


def _messy_rows(seed, big=False):
    """Entities with gaps, missing values, several rows per day and exact copies."""
    rng = random.Random(seed)
    rows = []
    for serial in "ABC":
        for day in rng.sample(range(1, 60), 30):
            text = f"2020-{1 + day // 29:02d}-{1 + day % 28:02d}"
            for copy in range(rng.choice([1, 1, 2, 4])):
                value = rng.choice([None, rng.randint(0, 9), 10**15 + rng.randint(0, 5) if big else rng.random()])
                rows += [_row(text, value, serial, hours=str(rng.randint(1, 99)), name=f"f{copy}")] * rng.choice([1, 1, 3])
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_summary_way_equals_plain_way(frame, seed):
    rows = _messy_rows(seed)
    typed = _typed(frame, rows, (5, 9))
    plain = feat.rolling_features(feat.change_features(typed, [5, 9]), [5, 9])
    hot = feat.hot_history_features(typed, [5, 9], limits=TINY)
    assert _rounded(plain) == _rounded(hot.select(*plain.columns))


def test_summary_way_keeps_small_deviations_of_large_values(frame):
    rows = [_row(f"2020-01-{d:02d}", 10**12 + d % 2, name=n) for d in range(1, 20) for n in "ab"]
    hot = feat.hot_history_features(_typed(frame, rows), [5], limits=TINY)
    last = hot.where("date = '2020-01-18'").first()
    assert math.isclose(last["smart_5_std_30d"], 0.5, rel_tol=1e-6)


def test_one_hot_entity_among_small_ones(frame):
    rows = _messy_rows(9) + [_row("2020-01-05", 3, "small"), _row("2020-01-06", 4, "small")]
    typed = _typed(frame, rows, (5, 9))
    sizes = typed.groupBy("serial_number").agg(F.count(F.lit(1)).alias("n_rows"))
    whole = feat.window_features(typed, [5, 9], sizes)
    split = feat.window_features(typed, [5, 9], sizes, Limits(broadcast_keys=1, hot_rows=50))
    assert _rounded(whole) == _rounded(split.select(*whole.columns))


def test_feature_table(frame):
    rows = [_row(f"2020-01-{d:02d}", d, hours=str(d)) for d in range(1, 11)] + [_row("2020-01-11", 50, failure="1", hours="9")]
    raw = frame(rows, RAW)
    table = feat.build_features(raw, horizon_days=3)
    # 197 and 198 have no values, 194 and 187 are not in the source.
    assert [c for c in table.columns if c.endswith("_raw_num")] == ["smart_5_raw_num", "smart_9_raw_num"]
    assert table.columns[:6] == ["date", "obs_date", "serial_number", "filename", "model", "capacity_bytes"]
    assert table.columns[-4:] == ["smart_5_change", "failure_date", "will_fail_30d", "label_status"]
    got = {r["date"]: r["will_fail_30d"] for r in table.collect()}
    assert got == {f"2020-01-{d:02d}": int(d >= 8) for d in range(1, 11)}
    joined = feat.build_features(raw, horizon_labels(raw, 3))
    assert _rounded(table) == _rounded(joined.select(*table.columns))


def test_failure_day_counts_in_history(frame):
    rows = [_row("2020-01-01", 100, failure="1"), _row("2020-01-02", 1), _row("2020-03-01", 1)]
    made = {r["date"]: r for r in _made(frame, rows).collect()}
    assert made["2020-01-02"]["smart_5_max_7d"] == 100


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_keys=1, hot_rows=2)])
def test_rows_without_day_or_entity_change_nothing(frame, limits):
    rows = [_row(f"2020-01-{d:02d}", d * d) for d in range(1, 12)]
    spoiled = [_row("someday", 777), _row(None, 888), _row("2020-01-03", 999, serial=None)]
    plain = feat.build_features(frame(rows, RAW), horizon_days=3)
    other = feat.build_features(frame(rows + spoiled, RAW), horizon_days=3, limits=limits)
    assert _rounded(plain) == _rounded(other.select(*plain.columns))


def test_copies_of_a_day(frame):
    rows = [_row("2020-01-01", 1)] * 2 + [_row("2020-03-01", 1)]
    raw = frame(rows, RAW)
    labeled = horizon_labels(raw, 30)
    assert feat.build_features(raw).count() == 2
    assert feat.build_features(raw, labeled).count() == 4
    assert feat.build_features(raw, labeled, repeat_duplicates=False).count() == 2


def test_hot_entities_keep_rows_without_a_day(frame):
    rows = [_row("2020-01-01", 1), _row("2020-01-02", 4), _row("someday", 7), _row(None, 9), _row("2020-01-03", None)]
    typed = _typed(frame, rows)
    entities = typed.groupBy("serial_number").count().withColumnRenamed("count", "n_rows")
    plain = feat.window_features(typed, [5], entities)
    hot = feat.window_features(typed, [5], entities, TINY)
    assert hot.count() == len(rows) and _rounded(plain) == _rounded(hot.select(*plain.columns))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_move_the_rows_as_little_as_possible(frame):
    raw = frame([_row(f"2020-01-{d:02d}", d) for d in range(1, 12)], RAW)
    labels_plan = _plan(horizon_labels(raw, 3))
    assert "hashpartitioning" not in labels_plan and "BroadcastHashJoin" in labels_plan
    # Both windows share one shuffle and one sort.
    features_plan = _plan(feat.build_features(raw, horizon_days=3))
    assert features_plan.count("hashpartitioning(serial_number") == 1
    assert features_plan.count("Sort [") == 1 and features_plan.count("+- Window [") == 2
    assert "SinglePartition" not in features_plan


def test_hot_entities_are_not_shuffled_for_labels(frame):
    rows = [_row(f"2020-01-{d:02d}", d) for d in range(1, 12)] + [_row("2020-01-01", 1, s) for s in "XYZ"]
    plan = _plan(horizon_labels(frame(rows, RAW), 3, Limits(broadcast_keys=1, hot_rows=5)))
    assert "Union" in plan and "LeftAnti" in plan
    assert "hashpartitioning" not in plan.split("LeftSemi")[1]


def test_nothing_usable(frame):
    with pytest.raises(ValueError, match="usable"):
        feat.build_features(frame([_row("2020-01-01", None, hours="x")], RAW))
    assert feat.covered_attributes(frame([_row("2020-01-01", 3)], RAW)) == [5, 9]
