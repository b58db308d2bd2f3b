"""Deterministic samples by a portable hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import bucket, hash32, row_key, sample_modulus
from fleetwatch.operators.labels import ENTITY, LABEL
from fleetwatch.operators.splits import TEST, SplitSpec, split_frames

WEIGHT = "sample_weight"


def _entity_in_sample(modulus: int) -> Column:
    return bucket(F.col(ENTITY), modulus) == 0 if modulus > 1 else F.lit(True)


def sample_training(df: DataFrame, fraction: float) -> DataFrame:
    """All positives and the healthy rows of 1 in n entities, weighted back to natural prevalence."""
    modulus = sample_modulus(fraction)
    positive = F.col(LABEL) == 1
    weight = F.when(positive, 1.0).otherwise(float(modulus))
    return df.where(positive | _entity_in_sample(modulus)).withColumn(WEIGHT, weight)


def sample_healthy(df: DataFrame, fraction: float) -> DataFrame:
    """Healthy rows of 1 in n entities."""
    return df.where((F.col(LABEL) == 0) & _entity_in_sample(sample_modulus(fraction)))


def sample_rows(df: DataFrame, modulus: int) -> DataFrame:
    """1 in n entity-days."""
    return df.where(bucket(row_key(), modulus) == 0)


def drilldown_sample(df: DataFrame, spec: SplitSpec, modulus: int = 100) -> DataFrame:
    """All positives and the rows of 1 in n entities of the test period."""
    if modulus < 1:
        raise ValueError("the modulus must be at least 1")
    test = split_frames(df, spec)[TEST]
    return test.where((F.col(LABEL) == 1) | _entity_in_sample(modulus))


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), the smallest by seeded hash."""
    draw = hash32(F.concat_ws(":", F.lit(str(seed)), row_key()))
    return df.orderBy(draw, ENTITY, "obs_date").limit(n)
