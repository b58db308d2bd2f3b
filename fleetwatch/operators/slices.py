"""Errors by slice of the test period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.days import month_key
from fleetwatch.functions.scores import ratio
from fleetwatch.operators.labels import LABEL

MIN_ROWS = 100


def error_slices(
    df: DataFrame, thresholds: dict[str, float], min_rows: int = MIN_ROWS, prefix: str = "risk_"
) -> DataFrame:
    """Per month and per model of device: recall, precision and errors of each scorer.

    The rows are read once, grouped by (month, model); both slicings and the unpivot of the scorers
    work on that small table. Rows without a model are a slice of their own.
    """
    positive = F.col(LABEL) == 1
    names = list(thresholds)
    flags = []
    for i, name in enumerate(names):
        alert = F.col(f"{prefix}{name}") >= F.lit(float(thresholds[name]))
        flags += [
            F.count(F.when(alert & positive, 1)).alias(f"tp_{i}"),
            F.count(F.when(alert & ~positive, 1)).alias(f"fp_{i}"),
        ]
    cells = df.groupBy(month_key(F.col("obs_date")).alias("month"), F.col("model").alias("device")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(positive, 1)).alias("positives"), *flags
    )
    sums = ["rows", "positives", *[f"{k}_{i}" for i in range(len(names)) for k in ("tp", "fp")]]

    def sliced(kind: str, by: str) -> DataFrame:
        grouped = cells.groupBy(F.col(by).alias("value")).agg(*[F.sum(c).alias(c) for c in sums])
        return grouped.where(F.col("rows") >= min_rows).withColumn("slice", F.lit(kind))

    both = reduce(DataFrame.unionByName, [sliced("month", "month"), sliced("model", "device")])
    triples = ", ".join(f"'{n}', tp_{i}, fp_{i}" for i, n in enumerate(names))
    long = both.selectExpr(
        "slice", "value", "rows", "positives", f"stack({len(names)}, {triples}) as (model, tp, fp)"
    )
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("positives")
    return long.select(
        "slice",
        "value",
        "model",
        "rows",
        "positives",
        (p / F.col("rows")).alias("prevalence"),
        F.when(p > 0, tp / p).alias("recall_at_validation_threshold"),
        ratio(tp, tp + fp).alias("precision_at_validation_threshold"),
        (p - tp).alias("false_negatives"),
        fp.alias("false_positives"),
    )
