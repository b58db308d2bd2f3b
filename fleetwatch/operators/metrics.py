"""Rare-event metrics: tie-exact thresholds, average precision, event coverage and lead time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.days import date_diff_days
from fleetwatch.functions.scores import ratio
from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.operators.ranking import (
    ROWS_PER_RANGE,
    Ranked,
    next_in_order,
    prefix_sum,
    score_groups,
)

THRESHOLD = "threshold_selected_on_validation_at_max_1pct_fpr"
# The metrics of one scorer on one split, in report order.
METRICS = (
    "rows",
    "positive_rows",
    "prevalence",
    "average_precision",
    THRESHOLD,
    "recall",
    "precision",
    "false_positive_rate",
    "alerts_per_1000_drive_days",
    "true_positives",
    "false_positives",
    "false_negatives",
    "true_negatives",
    "failure_events_with_any_alert_recall",
    "eligible_failure_events",
    "median_lead_days_detected_events",
)


def thresholds_at_budgets(
    df: DataFrame, scores: dict[str, str], budgets: list[float], rows_per_range: int = ROWS_PER_RANGE
) -> dict[tuple[str, float], float]:
    """Per (scorer, budget) the smallest score of a negative at which the false alarms stay within the budget.

    Ties count together. If even the highest score breaks the budget, the next float above it. The negatives are
    ranked once, whatever the number of scorers and budgets.
    """
    for share in budgets:
        if not 0 <= share <= 1:
            raise ValueError(f"a false-alarm budget of {share} is no share of the negatives")
    groups = score_groups(df.where(F.col(LABEL) == 0), scores)
    ranked = prefix_sum(
        groups, "score", ["neg"], descending=True, by=["model"], rows_per_range=rows_per_range
    ).rows
    sizes = ranked.groupBy("model").agg(F.sum("neg").alias("total"), F.max("score").alias("top"))

    def lowest(share: float) -> Column:
        allowed = F.floor(F.lit(float(share)) * F.col("total") + F.lit(1e-12))
        return F.min(F.when(F.col("cum_neg") <= allowed, F.col("score")))

    # One row per scorer.
    found = (
        ranked.join(F.broadcast(sizes), "model")
        .groupBy("model", "top")
        .agg(*[lowest(share).alias(f"at_{i}") for i, share in enumerate(budgets)])
        .collect()
    )
    if {r["model"] for r in found} != set(scores):
        raise ValueError("no negative rows to set a threshold on")
    above = {r["model"]: math.nextafter(r["top"], math.inf) for r in found}
    return {
        (r["model"], share): above[r["model"]] if r[f"at_{i}"] is None else r[f"at_{i}"]
        for r in found
        for i, share in enumerate(budgets)
    }


def thresholds_at_fpr(
    df: DataFrame, scores: dict[str, str], max_fpr: float = 0.01, rows_per_range: int = ROWS_PER_RANGE
) -> dict[str, float]:
    """The thresholds of all scorers at one budget, see ``thresholds_at_budgets``."""
    chosen = thresholds_at_budgets(df, scores, [max_fpr], rows_per_range)
    return {m: chosen[m, max_fpr] for m in scores}


def threshold_at_fpr(
    df: DataFrame, score: str, max_fpr: float = 0.01, rows_per_range: int = ROWS_PER_RANGE
) -> float:
    """The threshold of one score column."""
    return thresholds_at_fpr(df, {score: score}, max_fpr, rows_per_range)[score]


def _ranked_scores(df: DataFrame, scores: dict[str, str], rows_per_range: int) -> Ranked:
    groups = score_groups(df, scores)
    return prefix_sum(
        groups, "score", ["pos", "neg"], descending=True, by=["model"], rows_per_range=rows_per_range
    )


def average_precision(
    df: DataFrame, scores: dict[str, str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Per scorer: sum over distinct scores of the recall step times the precision there."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    gained = F.sum(F.when(F.col("pos") > 0, F.col("pos") * precision))
    value = F.coalesce(gained / F.nullif(F.sum("pos"), F.lit(0)), F.lit(0.0))
    ranked = _ranked_scores(df, scores, rows_per_range)
    return ranked.rows.groupBy("model").agg(value.alias("average_precision"))


def pr_curve(
    df: DataFrame,
    scores: dict[str, str],
    drop_intermediate: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Precision and recall per scorer at every distinct score, and the end point (1, 0).

    ``drop_intermediate`` leaves out points whose true positives equal those of both neighbours.
    """
    ranked = _ranked_scores(df, scores, rows_per_range)
    points = ranked.rows
    ends = points.groupBy("model").agg(
        F.sum("pos").alias("all_pos"), F.min("score").alias("lowest"), F.max("score").alias("highest")
    )
    if drop_intermediate:
        points = next_in_order(ranked, "pos", F.lit(0))
    points = points.join(F.broadcast(ends), "model")
    if drop_intermediate:
        edge = F.col("score").isin(F.col("lowest"), F.col("highest"))
        points = points.where(edge | (F.col("pos") > 0) | (F.col("next_pos") > 0))
    curve = points.select(
        "model",
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.when(F.col("all_pos") > 0, F.col("cum_pos") / F.col("all_pos")).otherwise(1.0).alias("recall"),
    )
    last = [(m, None, 1.0, 0.0) for m in scores]
    return curve.unionByName(df.sparkSession.createDataFrame(last, curve.schema))


def _alert(score: str, threshold: float) -> Column:
    return F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))


def event_rollup(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Per failure event: any alert, and the longest lead among the alerts. Events without a day stay."""
    alert = _alert(score, threshold)
    lead = date_diff_days(F.col("obs_date"), F.col("failure_date"))
    return (
        df.where(F.col(LABEL) == 1)
        .groupBy(ENTITY, "failure_date")
        .agg(F.max(alert).alias("detected"), F.max(F.when(alert, lead)).alias("lead_days"))
    )


def operating_metrics(df: DataFrame, thresholds: dict[str, float], prefix: str = "risk_") -> DataFrame:
    """One row per scorer with all counts and rates at its threshold.

    ``thresholds`` maps scorer name to threshold; the score column is ``prefix + name``. All scorers
    share one pass: rows are summed per (entity, event), then over all of them.
    """
    positive = F.col(LABEL) == 1
    lead = date_diff_days(F.col("obs_date"), F.col("failure_date"))
    first, second, reports = [], [], []
    for i, (name, threshold) in enumerate(thresholds.items()):
        alert = _alert(f"{prefix}{name}", threshold)
        first += [
            F.count(F.when(alert, 1)).alias(f"alerts_{i}"),
            F.max(F.when(alert, lead)).alias(f"lead_{i}"),
        ]
        fired, event = F.col(f"alerts_{i}"), F.col("is_event")
        detected = event & (fired > 0)
        second += [
            F.sum(F.when(event, fired).otherwise(0)).alias(f"tp_{i}"),
            F.sum(F.when(event, 0).otherwise(fired)).alias(f"fp_{i}"),
            F.count(F.when(detected, 1)).alias(f"detected_{i}"),
            F.percentile(F.when(detected, F.col(f"lead_{i}")), 0.5).alias(f"median_{i}"),
        ]
        tp, fp = F.col(f"tp_{i}"), F.col(f"fp_{i}")
        negatives = F.col("n") - F.col("p")
        reports.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col("n").alias("rows"),
                F.col("p").alias("positive_rows"),
                ratio(F.col("p"), F.col("n")).alias("prevalence"),
                F.lit(float(threshold)).alias(THRESHOLD),
                ratio(tp, F.col("p")).alias("recall"),
                ratio(tp, tp + fp).alias("precision"),
                ratio(fp, negatives).alias("false_positive_rate"),
                (ratio(tp + fp, F.col("n")) * 1000).alias("alerts_per_1000_drive_days"),
                tp.alias("true_positives"),
                fp.alias("false_positives"),
                (F.col("p") - tp).alias("false_negatives"),
                (negatives - fp).alias("true_negatives"),
                ratio(F.col(f"detected_{i}"), F.col("events")).alias(
                    "failure_events_with_any_alert_recall"
                ),
                F.col("events").alias("eligible_failure_events"),
                F.col(f"median_{i}").alias("median_lead_days_detected_events"),
            )
        )
    groups = df.groupBy(
        ENTITY,
        F.when(positive, F.col("failure_date")).alias("event_day"),
        F.coalesce(positive, F.lit(False)).alias("is_event"),
    ).agg(F.count(F.lit(1)).alias("group_rows"), *first)
    totals = groups.agg(
        F.coalesce(F.sum("group_rows"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("is_event"), F.col("group_rows"))), F.lit(0)).alias("p"),
        F.count(F.when(F.col("is_event"), 1)).alias("events"),
        *second,
    )
    filled = totals.na.fill(0, [c for c in totals.columns if c.startswith(("tp_", "fp_"))])
    return filled.select(F.inline(F.array(*reports)))


def tidy_metrics(wide: DataFrame, split: str) -> DataFrame:
    """One row per (model, split, metric) from one row per model."""
    names = [c for c in wide.columns if c != "model"]
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in names)
    return wide.selectExpr(
        "model", f"'{split}' as split", f"stack({len(names)}, {pairs}) as (metric, value)"
    )


def evaluate_scores(
    df: DataFrame,
    thresholds: dict[str, float],
    split: str,
    prefix: str = "risk_",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every metric of every scorer on one split, as tidy rows."""
    counts = tidy_metrics(operating_metrics(df, thresholds, prefix), split)
    ap = average_precision(df, {m: f"{prefix}{m}" for m in thresholds}, rows_per_range)
    return counts.unionByName(tidy_metrics(ap, split))


def cutoff_metrics(df: DataFrame, score: str, threshold: float, first_day, last_day) -> DataFrame:
    """Counts and rates of one cutoff on a range of days; empty denominators count as 1."""
    alert, positive = _alert(score, threshold), F.col(LABEL) == 1

    def rows_where(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = df.where(F.col("obs_date").between(F.lit(first_day), F.lit(last_day))).agg(
        rows_where(alert & positive).alias("tp"),
        rows_where(alert & ~positive).alias("fp"),
        rows_where(~alert & positive).alias("fn"),
        rows_where(~alert & ~positive).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        (tp + fp).alias("flagged"),
        (tp / F.greatest(F.lit(1), tp + fp)).alias("precision"),
        (tp / F.greatest(F.lit(1), tp + fn)).alias("recall"),
        (fp / F.greatest(F.lit(1), fp + tn)).alias("false_positive_rate"),
    )


def metrics_wide(tidy: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per model, one column ``<split>_<metric>`` each; the column set is fixed."""
    keyed = tidy.withColumn("column", F.concat_ws("_", "split", "metric"))
    columns = [f"{s}_{m}" for s in ("validation", "test") for m in metrics]
    return keyed.groupBy("model").pivot("column", columns).agg(F.first("value"))


def thresholds_of(tidy: DataFrame, split: str = "test") -> dict[str, float]:
    """Frozen thresholds by model, read back from stored metrics."""
    rows = tidy.where((F.col("split") == split) & (F.col("metric") == THRESHOLD)).select("model", "value")
    return dict(rows.collect())


def compare_models(tidy: DataFrame, split: str = "test") -> DataFrame:
    """Headline metrics, one row per model, best average precision first."""
    shown = (
        "average_precision",
        "recall",
        "precision",
        "false_positive_rate",
        "alerts_per_1000_drive_days",
        "failure_events_with_any_alert_recall",
        "median_lead_days_detected_events",
    )
    rows = tidy.where(F.col("split") == split)
    wide = rows.groupBy("model").pivot("metric", list(shown)).agg(F.first("value"))
    return wide.orderBy(F.desc("average_precision"), "model")


def best_model(tidy: DataFrame, split: str = "test") -> DataFrame:
    """The model with the highest average precision."""
    return compare_models(tidy, split).limit(1)


def lift(tidy: DataFrame, split: str = "test") -> DataFrame:
    """Average precision over prevalence, and the number of events covered."""
    names = [
        "average_precision",
        "prevalence",
        "failure_events_with_any_alert_recall",
        "eligible_failure_events",
    ]
    wide = tidy.where(F.col("split") == split).groupBy("model").pivot("metric", names).agg(F.first("value"))
    covered = F.col("failure_events_with_any_alert_recall") * F.col("eligible_failure_events")
    return wide.select(
        "model",
        ratio(F.col("average_precision"), F.col("prevalence")).alias("lift"),
        F.round(covered).cast("bigint").alias("covered_events"),
        F.col("eligible_failure_events").cast("bigint").alias("eligible_events"),
    )
