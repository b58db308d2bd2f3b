"""Thresholds, average precision, curves, operating points: fixed cases and brute force."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from fleetwatch.operators import metrics, ranking

SCHEMA = "obs_date date, serial_number string, model string, failure_date date, will_fail_30d int, risk_x double"
DAY = dt.date(2020, 1, 1)


def _scored(frame, pairs):
    rows = [(DAY, f"D{i}", "M", None, y, float(s)) for i, (y, s) in enumerate(pairs)]
    return frame(rows, SCHEMA)


def _random_pairs(seed, n=300, distinct=40):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.15), rng.randint(0, distinct) / distinct) for _ in range(n)]


@pytest.mark.parametrize(
    "negatives, budget, expected",
    [
        ([0.3, 0.35, 0.6, 0.6, 0.8], 0.2, 0.8),
        ([0.0, 0.15, 0.25, 0.45, 0.55, 0.65, 0.7, 0.7], 0.125, math.nextafter(0.7, math.inf)),
        ([0.05, 0.5], 0.2, math.nextafter(0.5, math.inf)),
        ([0.25] * 40 + [0.75] * 8 + [0.85] * 2, 0.04, 0.85),
    ],
)
@pytest.mark.parametrize("rows_per_range", [500_000, 2])
def test_threshold(frame, negatives, budget, expected, rows_per_range):
    df = _scored(frame, [(0, s) for s in negatives] + [(1, 0.95)])
    assert metrics.threshold_at_fpr(df, "risk_x", budget, rows_per_range) == expected


@pytest.mark.parametrize("seed", range(3))
def test_threshold_keeps_its_budget(frame, seed):
    pairs = _random_pairs(seed)
    negatives = [s for y, s in pairs if y == 0]
    for budget in (0.0, 0.01, 0.05, 0.5, 1.0):
        t = metrics.threshold_at_fpr(_scored(frame, pairs), "risk_x", budget, rows_per_range=7)
        allowed = math.floor(budget * len(negatives) + 1e-12)
        assert sum(s >= t for s in negatives) <= allowed
        lower = [s for s in set(negatives) if s < t]
        if lower:
            assert sum(s >= max(lower) for s in negatives) > allowed


def test_threshold_errors(frame):
    with pytest.raises(ValueError, match="no negative"):
        metrics.threshold_at_fpr(_scored(frame, [(1, 0.5)]), "risk_x")
    with pytest.raises(ValueError, match="no share"):
        metrics.threshold_at_fpr(_scored(frame, [(0, 0.5)]), "risk_x", 1.5)


def _ap(pairs):
    total = sum(y for y, _ in pairs)
    out = last = 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, v in pairs if v >= s)
        n = sum(1 for _, v in pairs if v >= s)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


@pytest.mark.parametrize("rows_per_range", [500_000, 9])
def test_average_precision(frame, rows_per_range):
    def ap(pairs):
        return metrics.average_precision(_scored(frame, pairs), {"x": "risk_x"}, rows_per_range).first()[1]

    assert math.isclose(ap([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4)]), 0.5 + 0.5 * 2 / 3)
    assert ap([(0, 0.9), (0, 0.8)]) == 0.0
    pairs = _random_pairs(5)
    assert math.isclose(ap(pairs), _ap(pairs), rel_tol=1e-12)


def _curve(pairs, drop):
    total = sum(y for y, _ in pairs)
    points = []
    for s in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, v in pairs if v >= s)
        points.append((s, tp, tp / sum(1 for _, v in pairs if v >= s), tp / total))
    if drop:
        last = len(points) - 1
        points = [
            p for i, p in enumerate(points)
            if i in (0, last) or points[i - 1][1] != p[1] or points[i + 1][1] != p[1]
        ]
    return {(s, round(p, 9), round(r, 9)) for s, _, p, r in points} | {(None, 1.0, 0.0)}


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("rows_per_range", [500_000, 5])
def test_curve(frame, drop, rows_per_range):
    pairs = _random_pairs(8, n=120, distinct=60)
    got = metrics.pr_curve(_scored(frame, pairs), {"x": "risk_x"}, drop, rows_per_range).collect()
    assert {(r[1], round(r[2], 9), round(r[3], 9)) for r in got} == _curve(pairs, drop)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_range", [1, 6, 10_000])
def test_prefix_sum(frame, descending, rows_per_range):
    rng = random.Random(3)
    rows = [(g, rng.choice([-1, 1]) * k / 7, rng.randint(0, 9)) for g in "ab" for k in range(50)]
    table = frame(rows, "g string, k double, v int")
    ranked = ranking.prefix_sum(table, "k", ["v"], descending, ["g"], rows_per_range)
    for r in ranked.rows.collect():
        before = [v for g, k, v in rows if g == r["g"] and (k >= r["k"] if descending else k <= r["k"])]
        assert r["cum_v"] == sum(before)
    assert ranked.n_ranges == -(-100 // rows_per_range)


def test_no_window_without_partition_over_rows(frame):
    """Only the few range totals may meet in one partition."""
    table = frame([(i / 3, 1) for i in range(100)], "k double, v int")
    plan = ranking.prefix_sum(table, "k", ["v"], rows_per_range=10).rows._jdf.queryExecution().executedPlan().toString()
    window_lines = [line for line in plan.splitlines() if "Window [" in line]
    assert any("inner_v" in line and "[key_range" in line for line in window_lines)


@pytest.mark.parametrize("rows_per_range", [500_000, 3])
def test_quantiles(frame, rows_per_range):
    rng = random.Random(1)
    values = [rng.choice([0.0, 0.5, rng.random()]) for _ in range(101)]
    shares = [0.0, 0.1, 0.37, 0.5, 1.0]
    got = ranking.exact_quantiles(frame([(v,) for v in values], "v double"), "v", shares, rows_per_range)
    ordered = sorted(values)
    for share, g in zip(shares, got):
        h = share * 100
        low = ordered[int(h)]
        high = ordered[min(int(h) + 1, 100)]
        assert math.isclose(g, low + (high - low) * (h - int(h)), abs_tol=1e-12)


def _day(n):
    return DAY + dt.timedelta(days=n)


def test_operating_point(frame):
    fail = _day(10)
    rows = [
        (_day(0), "A", "M", fail, 1, 0.9),
        (_day(4), "A", "M", fail, 1, 0.8),
        (_day(5), "A", "M", fail, 1, 0.1),
        (_day(0), "B", "M", fail, 1, 0.2),
        (_day(7), "C", "M", None, 1, 0.9),
        (_day(0), "D", "M", None, 0, 0.95),
        (_day(1), "D", "M", None, 0, 0.1),
        (_day(2), "D", "M", None, 0, 0.0),
    ]
    r = metrics.operating_metrics(frame(rows, SCHEMA), {"x": 0.8}).first().asDict()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["true_negatives"]) == (3, 1, 2, 2)
    assert r["recall"] == 0.6 and r["precision"] == 0.75 and r["false_positive_rate"] == 1 / 3
    assert r["alerts_per_1000_drive_days"] == 500 and r["prevalence"] == 5 / 8
    # Three events, one of them without a day; A and C are detected, only A has a lead.
    assert r["eligible_failure_events"] == 3
    assert math.isclose(r["failure_events_with_any_alert_recall"], 2 / 3)
    assert r["median_lead_days_detected_events"] == 10
    rolled = {x["serial_number"]: (x["detected"], x["lead_days"]) for x in metrics.event_rollup(frame(rows, SCHEMA), "risk_x", 0.8).collect()}
    assert rolled == {"A": (True, 10), "B": (False, None), "C": (True, None)}


def test_operating_point_without_positives_or_rows(frame):
    r = metrics.operating_metrics(_scored(frame, [(0, 0.1), (0, 0.2)]), {"x": 0.5}).first().asDict()
    assert r["recall"] == r["precision"] == r["failure_events_with_any_alert_recall"] == 0.0
    assert r["eligible_failure_events"] == 0 and r["median_lead_days_detected_events"] is None
    empty = metrics.operating_metrics(frame([], SCHEMA), {"x": 0.5}).first().asDict()
    assert empty["rows"] == 0 and empty["prevalence"] == 0.0


def test_tidy_and_wide(frame):
    df = _scored(frame, _random_pairs(2))
    tidy = metrics.evaluate_scores(df, {"x": 0.5}, "validation").unionByName(
        metrics.evaluate_scores(df, {"x": 0.5}, "test")
    )
    assert tidy.count() == 32
    wide = metrics.metrics_wide(tidy)
    assert wide.columns == ["model"] + [f"{s}_{m}" for s in ("validation", "test") for m in metrics.METRICS]
    assert metrics.thresholds_of(tidy) == {"x": 0.5}
    assert metrics.best_model(tidy).first()["model"] == "x"


def test_cutoff_on_an_empty_range(frame):
    r = metrics.cutoff_metrics(_scored(frame, [(1, 0.9)]), "risk_x", 0.5, "2021-01-01", "2021-01-02").first()
    assert (r["tp"], r["precision"], r["recall"], r["false_positive_rate"]) == (0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows_per_range", [500_000, 1, 2])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_nan_and_infinities(frame, rows_per_range, descending):
    keys = [-math.inf, -1.5, 1.0, 2.0, math.inf, math.nan]
    df = frame([(k, i + 1) for i, k in enumerate(keys)], "k double, n long")
    made = ranking.prefix_sum(df, "k", ["n"], descending=descending, rows_per_range=rows_per_range).rows
    got = {repr(r["k"]): r["cum_n"] for r in made.collect()}
    order = list(reversed(list(enumerate(keys, 1)))) if descending else list(enumerate(keys, 1))
    expected, total = {}, 0
    for n, k in order:
        total += n
        expected[repr(k)] = total
    assert got == expected
