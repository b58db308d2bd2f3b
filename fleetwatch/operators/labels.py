"""Censor-aware "fails within H days" labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.casts import failure_flag, lenient_date, truncated_flag
from fleetwatch.functions.days import date_diff_days
from fleetwatch.operators.keyed import DEFAULT_LIMITS, SIZE, KeySizes, Limits, join_lookup
from fleetwatch.session import cut

ENTITY = "serial_number"
LABEL = "will_fail_30d"
STATUS = "label_status"
DEFAULT_HORIZON = 30
LABEL_TAIL = ("failure_date", "last_seen", LABEL, STATUS)


def _check_horizon(horizon_days: int) -> None:
    if horizon_days < 1:
        raise ValueError(f"a horizon of {horizon_days} days is less than one day")


def failure_events(raw: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """Per entity: first failure day, last day seen and number of rows.

    ``extra`` adds aggregates to the same pass. Entities without an id have a row here as well.
    """
    day, flag = lenient_date("date"), failure_flag("failure")
    return raw.groupBy(ENTITY).agg(
        F.min(F.when(flag == 1, day)).alias("failure_date"),
        F.max(day).alias("last_seen"),
        F.count(F.lit(1)).alias(SIZE),
        *extra,
    )


def label_columns(day: Column, horizon_days: int) -> tuple[Column, Column]:
    """Label and status of a row that already knows its entity's failure day and last day."""
    ahead = date_diff_days(day, F.col("failure_date"))
    followed = F.col("failure_date").isNull() & (date_diff_days(day, F.col("last_seen")) >= horizon_days)
    soon = ahead.between(1, horizon_days)
    later = ahead > horizon_days
    label = F.when(soon, 1).when(later | followed, 0)
    status = (
        F.when(soon, "positive")
        .when(later, "negative_before_later_failure")
        .when(followed, "negative")
        .otherwise("insufficient_followup")
    )
    return label, status


def with_failure_event(
    rows: DataFrame,
    events: DataFrame,
    sizes: KeySizes | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows joined to their entity's failure day and last day; rows without an entity id drop out."""
    known = events.where(F.col(ENTITY).isNotNull()).select(ENTITY, "failure_date", "last_seen", SIZE)
    return join_lookup(rows, known, [ENTITY], sizes, limits)


def drop_failure_days(rows: DataFrame) -> DataFrame:
    """Rows whose failure flag is 0; any other flag is dropped, also 2."""
    return rows.where(failure_flag("failure") == 0)


def horizon_labels(
    raw: DataFrame, horizon_days: int = DEFAULT_HORIZON, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Source columns plus failure day, last day seen, label and status, without failure-day rows.

    A day counts as negative only with a full horizon of follow-up of its own entity.
    """
    _check_horizon(horizon_days)
    events = cut(failure_events(raw), "failure_events")
    label, status = label_columns(lenient_date("date"), horizon_days)
    rows = with_failure_event(drop_failure_days(raw), events, limits=limits)
    labeled = rows.withColumns({LABEL: label, STATUS: status})
    return labeled.select(*raw.columns, *LABEL_TAIL)


def label_counts(labeled: DataFrame) -> DataFrame:
    """Rows per label status, ordered by status."""
    return labeled.groupBy(STATUS).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(STATUS)


def eligible(labeled: DataFrame) -> DataFrame:
    """Rows with a known outcome."""
    return labeled.where(F.col(LABEL).isNotNull())


def of_class(rows: DataFrame, label: int) -> DataFrame:
    """Rows of one class."""
    return rows.where(F.col(LABEL) == label)


def _rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _contract_columns(day: Column, flag: Column) -> list[Column]:
    """What the contract needs to know of one entity."""
    return [
        _rows_where(day.isNull()).alias("bad_days"),
        _rows_where(F.col(ENTITY).isNull()).alias("no_entity"),
        _rows_where(~flag.isin(0, 1)).alias("bad_flags"),
        _rows_where(flag == 1).alias("failures"),
    ]


def _contract_totals(per_entity: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bad_days", "no_entity", "bad_flags")]
    return per_entity.agg(*sums, F.coalesce(F.max("failures"), F.lit(0)).alias("most_failures"))


def contract_counts(raw: DataFrame) -> DataFrame:
    """One row: rows with a bad day, without entity, with a flag other than 0 or 1, and the most
    failure rows of one entity."""
    facts = _contract_columns(lenient_date("date"), truncated_flag("failure"))
    return _contract_totals(raw.groupBy(ENTITY).agg(*facts))


def _require_columns(raw: DataFrame, horizon_days: int) -> None:
    missing = {"date", ENTITY, "failure"} - set(raw.columns)
    if missing:
        raise ValueError(f"the telemetry lacks {', '.join(sorted(missing))}")
    _check_horizon(horizon_days)


def _require_contract(totals: DataFrame) -> None:
    found = totals.first()
    if found["bad_days"] or found["no_entity"]:
        raise ValueError("a row has no device or no readable day")
    if found["bad_flags"]:
        raise ValueError("a failure flag is neither 0 nor 1")
    if found["most_failures"] > 1:
        raise ValueError("a device fails more than once")


def check_contract(raw: DataFrame, horizon_days: int = DEFAULT_HORIZON) -> None:
    """Raise ValueError where the strict label contract does not hold."""
    _require_columns(raw, horizon_days)
    _require_contract(contract_counts(raw))


def strict_labels(
    raw: DataFrame,
    horizon_days: int = DEFAULT_HORIZON,
    observed_through: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Labels against one global end of observation, failure-day rows kept.

    The contract is checked first, on the same per-entity pass that finds the failures.
    ``censor_reason`` is ``insufficient_followup`` only in the last horizon; an earlier row after its
    failure keeps ``eligible`` although ``label_eligible`` is 0.
    """
    _require_columns(raw, horizon_days)
    typed = raw.withColumns({"date": lenient_date("date"), "failure": truncated_flag("failure")})
    facts = _contract_columns(F.col("date"), F.col("failure"))
    events = cut(failure_events(typed, facts), "failure_events")
    _require_contract(_contract_totals(events))
    if observed_through is None:
        end = F.lit(events.agg(F.max("last_seen").alias("end")).first()["end"])
    else:
        end = F.to_date(F.lit(observed_through))
    day = F.col("date")
    rows = with_failure_event(typed, events, limits=limits)
    ahead = date_diff_days(day, F.col("failure_date"))
    positive = F.coalesce(ahead.between(1, horizon_days), F.lit(False))
    negative = F.coalesce(ahead > horizon_days, date_diff_days(day, end) >= horizon_days)
    known = positive | negative
    reason = (
        F.when(known, "eligible")
        .when(F.col("failure") == 1, "failure_day")
        .when(day >= F.date_sub(end, horizon_days), "insufficient_followup")
        .otherwise("eligible")
    )
    labeled = rows.withColumns(
        {
            "label_eligible": known.cast("int"),
            LABEL: F.when(known, positive.cast("int")),
            "censor_reason": reason,
        }
    )
    return labeled.select(*raw.columns, "failure_date", "label_eligible", LABEL, "censor_reason")


def first_failure_of(raw: DataFrame) -> DataFrame:
    """Entity to first failure day, entities that never failed left out."""
    return (
        failure_events(raw)
        .where(F.col(ENTITY).isNotNull() & F.col("failure_date").isNotNull())
        .select(ENTITY, "failure_date")
    )
