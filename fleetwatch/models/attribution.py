"""Why a row got its score: additive contributions of each feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.models.boosting import LEAF, BoostedTrees
from fleetwatch.models.prep import FEATURES
from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.operators.sampling import sample_rows

CONTRIBUTIONS = "contributions"
BASE = "base_value"
MARGIN = "margin"


def pick_cases(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """One detected failure, one missed failure and one false alarm, where there is one.

    The highest score among detected failures and false alarms, the lowest among missed failures;
    ties by entity and day.
    """
    alert, positive = F.col(score) >= F.lit(float(threshold)), F.col(LABEL) == 1
    kind = (
        F.when(positive & alert, "detected_failure")
        .when(positive & ~alert, "missed_failure")
        .when(~positive & alert, "false_alarm")
    )
    wanted = F.when(F.col("case_type") == "missed_failure", F.col(score)).otherwise(-F.col(score))
    columns = ["obs_date", ENTITY, "failure_date", LABEL, score]
    ranked = df.withColumn("case_type", kind).where(F.col("case_type").isNotNull())
    best = F.min(F.struct(wanted.alias("rank"), ENTITY, "obs_date", F.struct(*columns).alias("row")))
    return ranked.groupBy("case_type").agg(best.alias("best")).select("case_type", "best.row.*")


def attribute_logistic(prepared: DataFrame, model: LogisticRegressionModel, background: DataFrame) -> DataFrame:
    """``coef * (x - mean)`` per feature, the mean taken over the background; JVM only."""
    weights = [float(c) for c in model.coefficients]
    places = background.select(F.posexplode(vector_to_array(FEATURES)).alias("place", "x"))
    means = dict(places.groupBy("place").agg(F.avg("x")).collect())
    center = F.array(*[F.lit(float(means[i])) for i in range(len(weights))])
    coefficient = F.array(*[F.lit(w) for w in weights])
    base = model.intercept + sum(w * means[i] for i, w in enumerate(weights))
    x = vector_to_array(FEATURES)
    off = F.zip_with(x, center, lambda a, m: a - m)
    parts = F.zip_with(off, coefficient, lambda d, w: d * w)
    margin = F.aggregate(F.zip_with(x, coefficient, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return prepared.withColumns(
        {
            CONTRIBUTIONS: parts,
            BASE: F.lit(float(base)),
            MARGIN: margin + F.lit(float(model.intercept)),
        }
    )


def tree_paths(model: BoostedTrees) -> list[dict]:
    """Per leaf: its value, and per feature on its path the interval of values that stay on the path and the share of
    the training rows, by hessian, that do.

    Trees of depth 5 have at most 32 leaves each.
    """
    leaves = []
    for number, tree in enumerate(model.kept()):
        stack = [(1, {})]
        while stack:
            node, limits = stack.pop()
            feature = int(tree.feature[node])
            if feature == LEAF:
                leaves.append({"tree": number, "value": float(tree.value[node]), "limits": limits})
                continue
            threshold = model.threshold(tree, node)
            for child, is_left in ((2 * node, True), (2 * node + 1, False)):
                low, high, share = limits.get(feature, (-np.inf, np.inf, 1.0))
                share *= tree.cover[child] / tree.cover[node]
                if is_left:
                    high = min(high, threshold)
                else:
                    low = max(low, threshold)
                stack.append((child, {**limits, feature: (low, high, share)}))
    return leaves


def _leaf_weights(shares: list[float], inside: np.ndarray) -> np.ndarray:
    """Shapley weight of each path feature: rows by features.

    A feature that is known keeps the row on the path (1) or not (0); an unknown one keeps the training
    share. Subsets of the other features are summed by size.
    """
    n = len(shares)
    out = np.zeros(inside.shape)
    for i in range(n):
        sizes = np.zeros((len(inside), n))
        sizes[:, 0] = 1.0
        for count, j in enumerate(k for k in range(n) if k != i):
            known = np.zeros_like(sizes)
            known[:, 1 : count + 2] = sizes[:, : count + 1] * inside[:, [j]]
            sizes = sizes * shares[j] + known
        weight = np.array([1.0 / (n * _choose(n - 1, k)) for k in range(n)])
        out[:, i] = (inside[:, i] - shares[i]) * (sizes @ weight)
    return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def attribute_boosted(prepared: DataFrame, model: BoostedTrees) -> DataFrame:
    """Path-dependent Shapley values (Lundberg et al., 2018) of the boosted margin.

    The base value is the average prediction over the training rows of the trees.
    """
    spark = prepared.sparkSession
    leaves = tree_paths(model)
    start = model.base
    base = start + sum(leaf["value"] * np.prod([s for _, _, s in leaf["limits"].values()]) for leaf in leaves)
    shared = spark.sparkContext.broadcast(leaves)

    @F.pandas_udf("struct<contributions: array<double>, margin: double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            values, margin = np.zeros(x.shape), np.full(len(x), start)
            for leaf in shared.value:
                features = list(leaf["limits"])
                if not features:
                    margin += leaf["value"]
                    continue
                low, high, shares = (list(v) for v in zip(*leaf["limits"].values()))
                at = x[:, features] if len(x) else np.zeros((0, len(features)))
                inside = ((at > low) & (at <= high)).astype(float)
                margin += leaf["value"] * inside.prod(axis=1)
                if len(x):
                    values[:, features] += leaf["value"] * _leaf_weights(shares, inside)
            yield pd.DataFrame({"contributions": list(values), "margin": margin})

    explained = prepared.withColumn("explained", explain(vector_to_array(FEATURES)))
    return explained.withColumns(
        {
            CONTRIBUTIONS: F.col("explained.contributions"),
            BASE: F.lit(float(base)),
            MARGIN: F.col("explained.margin"),
        }
    ).drop("explained")


def attribute(prepared: DataFrame, model, background: DataFrame | None = None) -> DataFrame:
    """Contributions, base value and margin per row; contributions and base add up to the margin."""
    if isinstance(model, LogisticRegressionModel):
        return attribute_logistic(prepared, model, prepared if background is None else background)
    return attribute_boosted(prepared, model)


def explanation_sample(df: DataFrame, modulus: int = 500) -> DataFrame:
    """Hash sample of entity-days for the global view."""
    return sample_rows(df, modulus)


def _named(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def global_importance(explained: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """The k features with the largest mean absolute contribution."""
    places = explained.select(F.posexplode(CONTRIBUTIONS).alias("place", "value"))
    means = places.groupBy("place").agg(F.avg(F.abs("value")).alias("mean_abs"))
    named = means.select(F.element_at(_named(names), F.col("place") + 1).alias("feature"), "mean_abs")
    return named.orderBy(F.desc("mean_abs"), "feature").limit(k)


def top_contributors(explained: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """Adds ``top_feature_1`` to ``top_feature_k``: names by absolute contribution, ties by name."""
    pairs = F.zip_with(
        F.col(CONTRIBUTIONS),
        _named(names),
        lambda v, n: F.struct((-F.abs(v)).alias("rank"), n.alias("name")),
    )
    best = F.slice(F.array_sort(pairs), 1, k)
    ranked = explained.withColumn("ranked", best)
    columns = {f"top_feature_{i + 1}": F.get(F.col("ranked"), F.lit(i))["name"] for i in range(k)}
    return ranked.withColumns(columns).drop("ranked")
