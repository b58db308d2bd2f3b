"""Calibration of probability scores, and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.scores import clip01
from fleetwatch.operators.labels import LABEL
from fleetwatch.operators.ranking import ROWS_PER_RANGE, exact_quantiles


def calibration_bins(
    df: DataFrame, score: str, bins: int = 10, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows, mean score, observed prevalence and positives per quantile bin.

    Equal edges are merged, so heavy ties give fewer bins. The edges are a handful of literals.
    """
    p = df.select(clip01(F.col(score).cast("double")).alias("p"), F.col(LABEL).alias("y"))
    step = 1 / bins
    shares = [*(i * step for i in range(bins)), 1.0]
    edges = sorted(set(exact_quantiles(p, "p", shares, rows_per_range)))
    inner = edges[1:-1]
    passed = [F.when(F.col("p") >= e, 1).otherwise(0) for e in inner]
    number = sum(passed[1:], passed[0]) if passed else F.lit(0)
    return (
        p.groupBy(number.cast("int").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("p").alias("mean_predicted_probability"),
            F.avg("y").alias("observed_prevalence"),
            F.sum("y").alias("positives"),
        )
        .orderBy("bin")
    )


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error: gap between mean score and prevalence, weighted by rows."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_prevalence"))
    return bins.agg((F.sum(F.col("rows") * gap) / F.sum("rows")).alias("expected_calibration_error"))


def brier(df: DataFrame, score: str) -> DataFrame:
    """Mean squared distance between score and outcome."""
    off = clip01(F.col(score).cast("double")) - F.col(LABEL)
    return df.agg(F.avg(off * off).alias("brier_score"))


def histogram(df: DataFrame, column: str, bins: int = 36, by: str | None = None) -> DataFrame:
    """Equal-width bins over the range of the data, empty bins included, the last bin closed.

    ``by`` counts each class on the same edges. Only the two ends of the range reach the driver.
    """
    values = df.where(F.col(column).isNotNull())
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError("no values to count")
    low, high = (low - 0.5, high + 0.5) if low == high else (float(low), float(high))
    width = (high - low) / bins

    def edge(i):
        return F.when(i >= bins, F.lit(high)).otherwise(F.lit(low) + i * F.lit(width))

    v = F.col(column).cast("double")
    guess = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    # Rounding can put a value one bin off its own edges.
    fixed = F.when(v < edge(guess), guess - 1).when(
        (v >= edge(guess + 1)) & (guess < bins - 1), guess + 1
    )
    number = F.coalesce(fixed, guess).cast("int")
    keys = [number.alias("bin")] + ([F.col(by)] if by else [])
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        classes = F.array(*[F.lit(c) for c in (0, 1)])
        grid = grid.withColumn(by, F.explode(classes))
    on = ["bin"] + ([by] if by else [])
    filled = grid.join(counts, on, "left").na.fill(0, ["n"])
    return filled.select(
        *on,
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        "n",
    ).orderBy(*on)
