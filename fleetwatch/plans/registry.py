"""The registered queries, by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.functions.days import iso_dates
from fleetwatch.plans.stages import Study

Build = Callable[[Study], DataFrame]


@dataclass(frozen=True)
class Query:
    """A query over one data folder, and its SQL."""

    build: Build
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return comparable(self.build(Study(spark, folder)))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name."""

    def register(build: Build) -> Build:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = Query(build, sql)
        return build

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Dates as text and doubles to six places, so that two engines can be compared by value."""
    shown = iso_dates(df)
    return shown.select([F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in shown.dtypes])
