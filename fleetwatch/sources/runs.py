"""A store of runs: tables, metrics, thresholds, fitted models and parameters of a study, read as one version.

A run is a folder. Its parts are written first and its manifest last, so a run without a manifest is not there: a job that
dies half way leaves no readable run, and readers never see parts of two attempts, as each attempt writes to a folder
of its own which the manifest names. The manifest also holds rows and columns of each table, so counts and schemas are
compared without reading tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.models.bundle import Bundle, ForestBundle, load_bundle, load_forest, save_bundle, save_forest
from fleetwatch.models.forest import Forest
from fleetwatch.session import path_exists
from fleetwatch.sources.reports import METRIC_SCHEMA
from fleetwatch.sources.tables import open_table, write_table

MANIFEST = "body string"
RAW, LABELED, FEATURES, PREDICTIONS = "drive_days", "labeled", "features", "test_predictions"
METRICS, METRIC_COLUMNS = "metrics", [c.split()[0] for c in METRIC_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Run:
    """One committed run."""

    spark: SparkSession
    path: str
    tables: dict[str, dict]
    models: dict[str, str]
    thresholds: dict[str, float]
    parameters: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the run at {self.path} has no table {name}")
        return open_table(self.spark, f"{self.path}/{self.tables[name]['at']}")

    def rows(self, name: str) -> int:
        """Rows of a table as they were counted when it was written."""
        return self.tables[name]["rows"]

    def metrics(self) -> DataFrame:
        return self.table(METRICS)

    def model(self, name: str) -> Bundle | ForestBundle:
        at = f"{self.path}/{self.models[name]}"
        return load_forest(at) if path_exists(self.spark, f"{at}/nodes") else load_bundle(at)


def run_ids(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed runs below a folder, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory())
    return [n for n in names if path_exists(spark, f"{root}/{n}/manifest/_SUCCESS")]


def save_run(
    spark: SparkSession,
    root: str,
    name: str,
    tables: dict[str, DataFrame],
    metrics: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
    models: dict[str, tuple] | None = None,
    parameters: dict | None = None,
) -> Run:
    """Write the parts of a run, then its manifest; a name that is taken is refused.

    ``models`` holds (preprocessing, model, numeric inputs) by name; tables with a column ``obs_date`` are clustered by it.
    """
    path, attempt = f"{root}/{name}", uuid.uuid4().hex[:12]
    if path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"there is a run called {name} already")
    written, saved = {}, {}
    parts = tables | ({METRICS: metrics.select(*METRIC_COLUMNS)} if metrics is not None else {})
    for part, df in parts.items():
        at = f"{attempt}/{part}"
        write_table(df, f"{path}/{at}", "obs_date" if "obs_date" in df.columns else None)
        stored = open_table(spark, f"{path}/{at}")
        written[part] = {"at": at, "rows": stored.count(), "columns": stored.dtypes}
    for part, (prep, model, numeric) in (models or {}).items():
        at = f"{attempt}/model_{part}"
        (save_forest if isinstance(model, Forest) else save_bundle)(f"{path}/{at}", prep, model, numeric)
        saved[part] = at
    body = {"tables": written, "models": saved, "thresholds": thresholds or {}, "parameters": parameters or {}}
    manifest = spark.createDataFrame([(json.dumps(body, default=str),)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return open_run(spark, root, name)


def open_run(spark: SparkSession, root: str, name: str) -> Run:
    """A committed run; KeyError where there is none of that name."""
    path = f"{root}/{name}"
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise KeyError(f"no committed run called {name} in {root}")
    body = json.loads(spark.read.schema(MANIFEST).json(f"{path}/manifest").select(F.first("body")).first()[0])
    return Run(spark, path, body["tables"], body["models"], body["thresholds"], body["parameters"])
