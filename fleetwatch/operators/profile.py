"""Profile of a fleet: totals, population over time, prevalence, frequent models, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.casts import lenient_date, lenient_double
from fleetwatch.operators.features import ATTRIBUTES
from fleetwatch.operators.labels import ENTITY, LABEL

LOW_POPULATION = 5_000
TOP_MODELS = 10
TOP_SNAPSHOT_MODELS = 12


def fleet_totals(raw: DataFrame) -> DataFrame:
    """Rows, distinct entities, first and last day."""
    day = lenient_date("date")
    # Two levels: an entity is one row before anything is counted, however many rows it has.
    per_entity = raw.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last")
    )
    return per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(ENTITY).alias("n_entities"),
        F.min("first").alias("first_day"),
        F.max("last").alias("last_day"),
    )


def label_totals(features: DataFrame) -> DataFrame:
    """Rows, positives, negatives and prevalence in percent to four places."""
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(LABEL).alias("positives"),
        F.sum(F.when(F.col(LABEL) == 0, 1).otherwise(0)).alias("negatives"),
        F.round(F.avg(LABEL) * 100, 4).alias("prevalence_pct"),
    )


def daily_population(raw: DataFrame) -> DataFrame:
    """Rows per day."""
    return (
        raw.groupBy(lenient_date("date").alias("date")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("date")
    )


def monthly_prevalence(features: DataFrame) -> DataFrame:
    """Rows, positives and prevalence in percent per month."""
    return (
        features.groupBy(F.year("obs_date").alias("year"), F.month("obs_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(LABEL).alias("positives"),
            (F.avg(LABEL) * 100).alias("prevalence_pct"),
        )
        .orderBy("year", "month")
    )


def top_models(features: DataFrame, n: int = TOP_MODELS) -> DataFrame:
    """The n models with the most rows, ties by name."""
    counts = features.groupBy("model").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(LABEL).alias("positives")
    )
    return counts.orderBy(F.desc("row_count"), F.asc_nulls_last("model")).limit(n)


def missingness(raw: DataFrame, attrs: tuple[int, ...] = ATTRIBUTES) -> DataFrame:
    """Percent of rows without a usable value, one row per attribute."""
    shares = [
        (F.avg(F.when(lenient_double(f"smart_{n}_raw").isNull(), 1.0).otherwise(0.0)) * 100).alias(f"pct_{n}")
        for n in attrs
    ]
    pairs = ", ".join(f"{n}, pct_{n}" for n in attrs)
    return raw.agg(*shares).selectExpr(f"stack({len(attrs)}, {pairs}) as (attribute, missing_pct)")


def low_population(daily: DataFrame, limit: int = LOW_POPULATION) -> DataFrame:
    """First and last day with fewer rows than the limit."""
    return daily.where(F.col("row_count") < limit).agg(
        F.min("date").alias("first_low_day"), F.max("date").alias("last_low_day")
    )


def daily_alerts(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Per day: rows, positives, alerts and detected positives."""
    alert = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    return (
        df.groupBy("obs_date")
        .agg(
            F.count(F.lit(1)).alias("drive_days"),
            F.sum(LABEL).alias("positive_days"),
            F.count(F.when(alert, 1)).alias("alerts"),
            F.count(F.when(alert & (F.col(LABEL) == 1), 1)).alias("detected_days"),
        )
        .orderBy("obs_date")
    )


def snapshot_models(snapshot: DataFrame, n: int = TOP_SNAPSHOT_MODELS) -> DataFrame:
    """The n models with the most records in a snapshot, smallest first; no model is a model too."""
    counts = snapshot.groupBy("model").agg(
        F.count(F.lit(1)).alias("drive_records"),
        F.count(F.when(F.col("failure"), 1)).alias("failures"),
    )
    top = counts.orderBy(F.desc("drive_records"), F.asc_nulls_last("model")).limit(n)
    return top.orderBy("drive_records", F.desc_nulls_first("model"))
