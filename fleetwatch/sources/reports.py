"""Report tables: metrics as JSON and wide CSV, review rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.functions.days import iso_dates
from fleetwatch.operators.metrics import metrics_wide

METRIC_SCHEMA = "model string, split string, metric string, value double"


def write_metrics(tidy: DataFrame, path: str) -> None:
    """Tidy metrics as JSON lines and one CSV row per model; both hold a few rows per model only."""
    tidy.coalesce(1).write.json(f"{path}/metrics_json")
    metrics_wide(tidy).coalesce(1).write.option("header", "true").csv(f"{path}/metrics_csv")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The tidy metrics ``write_metrics`` stored."""
    return spark.read.schema(METRIC_SCHEMA).json(f"{path}/metrics_json")


def write_records(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, days as ``yyyy-MM-dd`` text and missing values spelled out."""
    iso_dates(df).write.option("ignoreNullFields", "false").json(path)
