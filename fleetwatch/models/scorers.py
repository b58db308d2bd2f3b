"""Supervised scorers on prepared features, and scoring with several of them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.scores import rule_score
from fleetwatch.models.boosting import BoostedTrees, Boosting, fit_boosted_trees
from fleetwatch.models.prep import FEATURES
from fleetwatch.operators.labels import LABEL
from fleetwatch.operators.sampling import WEIGHT

# Settings of the learners.
LOGISTIC_ITERATIONS = 80
LOGISTIC_C = 1.0

RULE = "sector_count_rule"


def class_counts(df: DataFrame) -> DataFrame:
    """One row: negatives, positives and rows with neither label."""
    y = F.col(LABEL)
    return df.agg(
        F.count(F.when(y == 0, 1)).alias("negatives"),
        F.count(F.when(y == 1, 1)).alias("positives"),
        F.count(F.when(y.isNull() | ~y.isin(0, 1), 1)).alias("other"),
    )


def check_classes(df: DataFrame, name: str, both: bool = True) -> None:
    """Raise ValueError for an empty split, a non-binary label or, if wanted, a missing class."""
    found = class_counts(df).first()
    if found["other"] or not found["negatives"] + found["positives"]:
        raise ValueError(f"{name} must be non-empty with labels 0 and 1")
    if both and not (found["negatives"] and found["positives"]):
        raise ValueError(f"{name} must contain both classes")


def fit_logistic(prepared: DataFrame, weight: str = WEIGHT) -> LogisticRegressionModel:
    """Weighted logistic regression with an L2 penalty worth ``1 / C`` of the summed loss."""
    total = prepared.agg(F.sum(weight)).first()[0]
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=weight,
        maxIter=LOGISTIC_ITERATIONS,
        regParam=1.0 / (LOGISTIC_C * total),
        standardization=False,
    ).fit(prepared)


def logistic_gradient(
    prepared: DataFrame, model: LogisticRegressionModel, names: list[str], weight: str = WEIGHT
) -> DataFrame:
    """(feature, slope, size): derivative of the penalised loss by each coefficient, and the size of its terms.

    One pass with map-side combine; a row per coefficient.
    """
    x = vector_to_array(FEATURES)
    coefficients = [float(c) for c in model.coefficients]
    margin = F.aggregate(
        F.zip_with(x, F.array(*[F.lit(c) for c in coefficients]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    ) + F.lit(float(model.intercept))
    off = F.col(weight) * (1 / (1 + F.exp(-margin)) - F.col(LABEL))
    rows = prepared.select(off.alias("off"), F.posexplode(F.concat(x, F.array(F.lit(1.0)))).alias("place", "value"))
    part = F.col("off") * F.col("value")
    sums = rows.groupBy("place").agg(F.sum(part).alias("slope"), F.sum(F.abs(part)).alias("size"))
    own = F.array(*[F.lit(c / LOGISTIC_C) for c in coefficients], F.lit(0.0))
    named = F.array(*[F.lit(n) for n in [*names, "intercept"]])
    penalty = F.get(own, F.col("place"))
    return sums.select(
        F.get(named, F.col("place")).alias("feature"),
        (F.col("slope") + penalty).alias("slope"),
        (F.col("size") + F.abs(penalty)).alias("size"),
    )


def fit_boosted(
    prepared: DataFrame, validation: DataFrame | None = None, weight: str = WEIGHT, seed: int = 42, **settings
) -> BoostedTrees:
    """Weighted boosted trees; with validation rows, as many as give their best average precision.

    ``settings`` are fields of ``Boosting``.
    """
    return fit_boosted_trees(prepared, validation, weight, seed, Boosting(**settings))


def _probability(df: DataFrame, model, name: str) -> DataFrame:
    if isinstance(model, BoostedTrees):
        return df.withColumn(f"risk_{name}", model.probability(F.col(FEATURES)))
    out = {"p": f"{name}__p", "raw": f"{name}__raw", "label": f"{name}__label"}
    scored = (
        model.setProbabilityCol(out["p"]).setRawPredictionCol(out["raw"]).setPredictionCol(out["label"]).transform(df)
    )
    return scored.withColumn(f"risk_{name}", vector_to_array(out["p"])[1]).drop(*out.values())


def score_holdout(prepared: DataFrame, models: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """``risk_<name>`` per model, and the sector-count rule where its two counters exist.

    ``keep`` names further columns to carry along.
    """
    scored = prepared
    for name, model in models.items():
        scored = _probability(scored, model, name)
    if {"smart_5_raw_num", "smart_197_raw_num"} <= set(scored.columns):
        rule = rule_score(F.col("smart_5_raw_num"), F.col("smart_197_raw_num"))
        scored = scored.withColumn(f"risk_{RULE}", rule)
    keys = ["obs_date", "serial_number", "model", "failure_date", LABEL]
    return scored.select(*keys, *[c for c in scored.columns if c.startswith("risk_")], *keep)
