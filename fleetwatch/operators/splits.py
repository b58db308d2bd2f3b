"""Chronological splits with a gap of one label horizon before each boundary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.casts import to_day
from fleetwatch.operators.labels import LABEL

TRAIN, VALIDATION, TEST, OUTSIDE = "train", "validation", "test", "purged_or_outside"


@dataclass(frozen=True)
class SplitSpec:
    """Boundaries of the three periods; a label of ``horizon_days`` may not reach into the next one."""

    train_end: date
    validation_end: date
    test_end: date
    horizon_days: int = 30
    validation_start: date | None = None
    test_start: date | None = None

    def __post_init__(self) -> None:
        for name in ("train_end", "validation_end", "test_end", "validation_start", "test_start"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, date.fromisoformat(value))
        if self.validation_start is None:
            object.__setattr__(self, "validation_start", self.train_end)
        if self.test_start is None:
            object.__setattr__(self, "test_start", self.validation_end)
        if not (
            self.train_end
            <= self.validation_start
            < self.validation_end
            <= self.test_start
            < self.test_end
        ):
            raise ValueError(
                "need train_end <= validation_start < validation_end <= test_start < test_end"
            )

    def _before(self, day: date) -> date:
        return day - timedelta(days=self.horizon_days)

    @property
    def train_cut(self) -> date:
        return self._before(self.train_end)

    @property
    def validation_cut(self) -> date:
        return self._before(self.validation_end)

    @property
    def test_cut(self) -> date:
        return self._before(self.test_end)

    def require_periods(self) -> None:
        """Raise where the gap leaves a period empty or out of order."""
        if not (
            self.train_cut
            <= self.validation_start
            < self.validation_cut
            <= self.test_start
            < self.test_cut
        ):
            raise ValueError("a period is empty once the gaps are cut, or comes too early")

    def conditions(self, day: Column) -> dict[str, Column]:
        """Range condition of each split; bounds are literals, so they reach the scan."""
        return {
            TRAIN: day < F.lit(self.train_cut),
            VALIDATION: (day >= F.lit(self.validation_start)) & (day < F.lit(self.validation_cut)),
            TEST: (day >= F.lit(self.test_start)) & (day <= F.lit(self.test_cut)),
        }


def temporal_masks(df: DataFrame, spec: SplitSpec, day: str = "obs_date") -> DataFrame:
    """Three boolean columns, at most one of them true."""
    masks = spec.conditions(to_day(day))
    return df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in masks.items()})


def split_frames(df: DataFrame, spec: SplitSpec, day: str = "obs_date") -> dict[str, DataFrame]:
    """Train, validation and test rows as lazy filters on one table."""
    spec.require_periods()
    return {name: df.where(c) for name, c in spec.conditions(F.col(day)).items()}


def split_label(day: Column, spec: SplitSpec) -> Column:
    """Name of the split a day belongs to."""
    masks = spec.conditions(day)
    label = F.when(masks[TRAIN], TRAIN)
    for name in (VALIDATION, TEST):
        label = label.when(masks[name], name)
    return label.otherwise(OUTSIDE)


def split_summary(df: DataFrame, spec: SplitSpec) -> DataFrame:
    """Rows, positives and prevalence in percent per split, ordered by name."""
    return (
        df.groupBy(split_label(F.col("obs_date"), spec).alias("split"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(LABEL).alias("positives"),
            (F.avg(LABEL) * 100).alias("prevalence_pct"),
        )
        .orderBy("split")
    )
