"""Rules of the two label variants, each on a handful of days."""

from __future__ import annotations

import datetime as dt

import pytest

from fleetwatch.operators import labels
from fleetwatch.operators.keyed import Limits

SCHEMA = "date string, serial_number string, failure string"


def _by_key(df, *columns):
    return {(r["serial_number"], str(r["date"])): tuple(r[c] for c in columns) for r in df.collect()}


# P fails 24 and 5 days later; Q is seen for 65 and 31 days more, then no more; R fails 65 and 16 days later.
BASE = [
    ("2021-03-01", "P", "0"),
    ("2021-03-20", "P", "0"),
    ("2021-03-25", "P", "1"),
    ("2021-03-01", "Q", "0"),
    ("2021-04-04", "Q", "0"),
    ("2021-05-05", "Q", "0"),
    ("2021-03-02", "R", "0"),
    ("2021-04-20", "R", "0"),
    ("2021-05-06", "R", "1"),
]
EXPECTED = {
    ("P", "2021-03-01"): (1, "positive"),
    ("P", "2021-03-20"): (1, "positive"),
    ("Q", "2021-03-01"): (0, "negative"),
    ("Q", "2021-04-04"): (0, "negative"),
    ("Q", "2021-05-05"): (None, "insufficient_followup"),
    ("R", "2021-03-02"): (0, "negative_before_later_failure"),
    ("R", "2021-04-20"): (1, "positive"),
}


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_keys=1, hot_rows=2), Limits(broadcast_keys=1)])
def test_base_cases_on_every_join_path(frame, limits):
    labeled = labels.horizon_labels(frame(BASE, SCHEMA), 30, limits)
    assert _by_key(labeled, "will_fail_30d", "label_status") == EXPECTED
    assert labeled.columns == ["date", "serial_number", "failure", *labels.LABEL_TAIL]


def test_boundaries(frame):
    rows = [
        ("2020-01-01", "gap30", "0"),
        ("2020-01-31", "gap30", "1"),
        ("2020-01-01", "gap31", "0"),
        ("2020-02-01", "gap31", "1"),
        ("2020-01-01", "seen30", "0"),
        ("2020-01-31", "seen30", "0"),
        ("2020-01-01", "seen29", "0"),
        ("2020-01-30", "seen29", "0"),
    ]
    got = _by_key(labels.horizon_labels(frame(rows, SCHEMA)), "will_fail_30d", "label_status")
    assert got["gap30", "2020-01-01"] == (1, "positive")
    assert got["gap31", "2020-01-01"] == (0, "negative_before_later_failure")
    assert got["seen30", "2020-01-01"] == (0, "negative")
    assert got["seen29", "2020-01-01"] == (None, "insufficient_followup")


def test_odd_rows(frame):
    rows = [
        ("2020-01-01", "late", "1"),
        ("2020-01-02", "late", "0"),
        ("2020-01-01", "two", "2"),
        ("2020-03-01", "two", "0"),
        ("2020-01-01", "one", "0"),
        ("2020-01-02", "one", "1.0"),
        ("2020-01-01", "text", "yes"),
        ("2020-03-01", "text", None),
        ("someday", "bad", "0"),
        ("2020-01-01", None, "0"),
        ("2020-01-01", "twice", "0"),
        ("2020-01-05", "twice", "1"),
        ("2020-01-20", "twice", "1"),
    ]
    got = _by_key(labels.horizon_labels(frame(rows, SCHEMA)), "will_fail_30d", "label_status", "failure_date")
    assert got["late", "2020-01-02"][:2] == (None, "insufficient_followup")
    assert ("two", "2020-01-01") not in got
    assert got["two", "2020-03-01"][2] is None
    assert got["one", "2020-01-01"][:2] == (1, "positive")
    assert got["text", "2020-01-01"][:2] == (0, "negative")
    assert got["bad", "someday"][:2] == (None, "insufficient_followup")
    assert not [k for k in got if k[0] is None]
    assert got["twice", "2020-01-01"][2] == dt.date(2020, 1, 5)


def test_counts_are_ordered(frame):
    counts = labels.label_counts(labels.horizon_labels(frame(BASE, SCHEMA))).collect()
    assert [tuple(r) for r in counts] == [
        ("insufficient_followup", 1),
        ("negative", 2),
        ("negative_before_later_failure", 1),
        ("positive", 3),
    ]


def test_strict_labels(frame):
    rows = [*BASE, ("2021-04-20", "P", "0")]
    got = _by_key(
        labels.strict_labels(frame(rows, SCHEMA)), "label_eligible", "will_fail_30d", "censor_reason"
    )
    assert got["P", "2021-03-20"] == (1, 1, "eligible")
    assert got["P", "2021-03-25"] == (0, None, "failure_day")
    # A day after the failure, in the last horizon.
    assert got["P", "2021-04-20"] == (0, None, "insufficient_followup")
    assert got["Q", "2021-03-01"] == (1, 0, "eligible")
    assert got["Q", "2021-05-05"] == (0, None, "insufficient_followup")
    assert got["R", "2021-05-06"] == (0, None, "failure_day")


def test_strict_row_after_failure_long_before_the_end_keeps_its_reason(frame):
    rows = [("2020-01-01", "A", "1"), ("2020-01-02", "A", "0"), ("2020-06-01", "B", "0")]
    got = _by_key(labels.strict_labels(frame(rows, SCHEMA)), "label_eligible", "censor_reason")
    assert got["A", "2020-01-02"] == (0, "eligible")


def test_strict_uses_one_end_of_observation(frame):
    rows = [("2020-01-01", "gone", "0"), ("2020-06-01", "stays", "0")]
    strict = _by_key(labels.strict_labels(frame(rows, SCHEMA)), "will_fail_30d")
    lenient = _by_key(labels.horizon_labels(frame(rows, SCHEMA)), "will_fail_30d")
    assert strict["gone", "2020-01-01"] == (0,)
    assert lenient["gone", "2020-01-01"] == (None,)
    shifted = labels.strict_labels(frame(rows, SCHEMA), observed_through="2020-01-15")
    assert _by_key(shifted, "will_fail_30d")["gone", "2020-01-01"] == (None,)


@pytest.mark.parametrize(
    "rows, message",
    [
        ([("someday", "A", "0")], "readable day"),
        ([("2020-01-01", None, "0")], "readable day"),
        ([("2020-01-01", "A", "2")], "neither 0 nor 1"),
        ([("2020-01-01", "A", "1"), ("2020-01-02", "A", "1")], "fails more than once"),
    ],
)
def test_contract(frame, rows, message):
    with pytest.raises(ValueError, match=message):
        labels.strict_labels(frame(rows, SCHEMA))


def test_contract_on_arguments(frame):
    with pytest.raises(ValueError, match="lacks"):
        labels.check_contract(frame([("2020-01-01", "A")], "date string, serial_number string"))
    with pytest.raises(ValueError, match="less than one day"):
        labels.horizon_labels(frame(BASE, SCHEMA), 0)
