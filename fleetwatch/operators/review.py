"""Read queries behind a review screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.operators.sampling import sample_n

# Sizes of the review lists.
REVIEW_NEGATIVES = 3_200
REVIEW_ALERTS = 1_800
SCREEN_ROWS = 500
BYTES_PER_TB = 1_000_000_000_000
# Texts and column titles shown to reviewers.
OUTCOME_POSITIVE = "Failure recorded in next 30 days"
OUTCOME_NEGATIVE = "No positive label"
SNAPSHOT_TITLES = {
    "date": "Snapshot date",
    "serial_number": "Serial number",
    "model": "Drive model",
    "capacity_tb": "Capacity (TB)",
    "failure": "Failure recorded",
    "smart_5_raw": "Reallocated sectors · SMART 5",
    "smart_9_raw": "Power-on hours · SMART 9",
    "smart_187_raw": "Reported uncorrectable · SMART 187",
    "smart_188_raw": "Command timeout · SMART 188",
    "smart_194_raw": "Temperature · SMART 194",
    "smart_197_raw": "Pending sectors · SMART 197",
    "smart_198_raw": "Uncorrectable sectors · SMART 198",
}


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive literal substring; NULL does not contain anything."""
    return F.coalesce(F.lower(c.cast("string")).contains(text.lower()), F.lit(False))


def ordered(df: DataFrame) -> DataFrame:
    """Rows by day and entity; only where the order itself is wanted."""
    return df.orderBy("obs_date", ENTITY)


def top_alerts(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k highest scores; ties by entity and day."""
    return df.orderBy(F.desc_nulls_last(score), ENTITY, "obs_date").limit(k)


def review_filter(
    df: DataFrame,
    first_day=None,
    last_day=None,
    model: str | None = None,
    failed: bool | None = None,
    serial: str | None = None,
    day: str = "obs_date",
) -> DataFrame:
    """Rows in a range of days, of one model, with or without a failure, whose serial holds a text."""
    conditions = []
    if first_day is not None and last_day is not None:
        conditions.append(F.col(day).between(F.lit(first_day), F.lit(last_day)))
    if model is not None:
        conditions.append(F.col("model") == model)
    if failed is not None:
        conditions.append(F.col("failure") == F.lit(failed))
    if serial:
        conditions.append(contains_text(F.col(ENTITY), serial))
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def search_reviews(
    df: DataFrame,
    text: str = "",
    day: str | None = None,
    outcome: int | None = None,
    sort_by: str = "risk_boosted_trees",
) -> DataFrame:
    """Rows whose serial or model holds a text, on one day, with one outcome, highest score first."""
    rows = df
    if text:
        rows = rows.where(contains_text(F.col(ENTITY), text) | contains_text(F.col("model"), text))
    if day:
        rows = rows.where(F.col("obs_date") == F.lit(day).cast("date"))
    if outcome is not None:
        rows = rows.where(F.col(LABEL) == outcome)
    return rows.orderBy(F.desc_nulls_last(sort_by), ENTITY, "obs_date")


def review_sort(snapshot: DataFrame) -> DataFrame:
    """Failures first, then the most reallocated sectors, missing values last; ties by entity."""
    return snapshot.orderBy(F.desc_nulls_last("failure"), F.desc_nulls_last("smart_5_raw"), ENTITY)


def with_review_columns(df: DataFrame) -> DataFrame:
    """Capacity in TB and the outcome in words, for the columns the table has."""
    added = {}
    if "capacity_bytes" in df.columns:
        added["capacity_tb"] = F.col("capacity_bytes") / BYTES_PER_TB
    if LABEL in df.columns:
        added["outcome"] = F.when(F.col(LABEL) == 1, OUTCOME_POSITIVE).otherwise(OUTCOME_NEGATIVE)
    return df.withColumns(added) if added else df


def daily_rates(daily: DataFrame) -> DataFrame:
    """Positives and alerts per 1,000 rows of each day."""
    return daily.select(
        "obs_date",
        (F.col("positive_days") / F.col("drive_days") * 1000).alias("positives_per_1000"),
        (F.col("alerts") / F.col("drive_days") * 1000).alias("alerts_per_1000"),
    )


def titled_snapshot(snapshot: DataFrame, rows: int = SCREEN_ROWS) -> DataFrame:
    """The first rows of a sorted snapshot under the titles reviewers see."""
    shown = review_sort(with_review_columns(snapshot)).limit(rows)
    return shown.select(*[F.col(c).alias(t) for c, t in SNAPSHOT_TITLES.items()])


def risk_review_set(
    df: DataFrame,
    score: str,
    negatives: int = REVIEW_NEGATIVES,
    alerts: int = REVIEW_ALERTS,
    seed: int = 42,
) -> DataFrame:
    """All positives, a sample of negatives and the top alerts, once each, highest score first."""
    parts = [
        df.where(F.col(LABEL) == 1),
        sample_n(df.where(F.col(LABEL) == 0), negatives, seed),
        top_alerts(df, score, alerts),
    ]
    once = stack_tables(*parts).dropDuplicates(["obs_date", ENTITY])
    return once.orderBy(F.desc_nulls_last(score), ENTITY, "obs_date")


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Tables one below the other, columns by name."""
    return reduce(DataFrame.unionByName, tables)


def choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in order, without NULL."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def drive_history(df: DataFrame, entity: str, first_day=None, last_day=None) -> DataFrame:
    """All rows of one entity by day."""
    return review_filter(df.where(F.col(ENTITY) == entity), first_day, last_day).orderBy("obs_date")


def drive_summary(history: DataFrame) -> DataFrame:
    """One row: days, first known model, whether any day is positive, first failure day."""
    return history.agg(
        F.count(F.lit(1)).alias("days"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("obs_date"))).alias("model"),
        F.coalesce(F.max(LABEL), F.lit(0)).alias("any_positive"),
        F.min("failure_date").alias("failure_date"),
    )
