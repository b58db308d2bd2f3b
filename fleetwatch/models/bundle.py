"""Saving a fitted scorer with the feature list it was fitted on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from fleetwatch.models.boosting import BoostedTrees, load_trees, save_trees
from fleetwatch.models.forest import Forest, score_isolation
from fleetwatch.models.prep import prepare
from fleetwatch.models.scorers import score_holdout
from fleetwatch.session import path_exists
from fleetwatch.sources.tables import feature_columns


@dataclass(frozen=True)
class Bundle:
    """Preprocessing, one scorer and the numeric inputs, in order."""

    prep: PipelineModel
    scorer: object
    numeric: list[str]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Prediction rows; a table with other numeric columns is refused."""
        require_features(df, self.numeric)
        return score_holdout(prepare(df, self.prep), {name: self.scorer})


def require_features(df: DataFrame, numeric: list[str]) -> None:
    """Raise ValueError where the numeric inputs of a table are not the fitted ones, in order."""
    if feature_columns(df.columns)[0] != numeric:
        raise ValueError("the feature columns differ from those the model was fitted on")


def save_bundle(path: str, prep: PipelineModel, model, numeric: list[str]) -> None:
    """Write preprocessing, scorer and feature list below a path."""
    spark = SparkSession.active()
    prep.save(f"{path}/prep")
    if isinstance(model, BoostedTrees):
        save_trees(f"{path}/trees", model)
    else:
        PipelineModel(stages=[model]).save(f"{path}/scorer")
    listed = spark.createDataFrame(list(enumerate(numeric)), "position int, name string")
    listed.coalesce(1).write.json(f"{path}/numeric_features")


def load_bundle(path: str) -> Bundle:
    """Read back what ``save_bundle`` wrote."""
    spark = SparkSession.active()
    listed = spark.read.schema("position int, name string").json(f"{path}/numeric_features")
    numeric = [r["name"] for r in listed.orderBy("position").collect()]
    if path_exists(spark, f"{path}/trees"):
        scorer: object = load_trees(f"{path}/trees")
    else:
        scorer = PipelineModel.load(f"{path}/scorer").stages[0]
    return Bundle(PipelineModel.load(f"{path}/prep"), scorer, numeric)


@dataclass(frozen=True)
class ForestBundle:
    """Preprocessing, a forest and the numeric inputs, in order."""

    prep: PipelineModel
    forest: Forest
    numeric: list[str]

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Prepared rows with the anomaly score; a table with other numeric columns is refused."""
        require_features(df, self.numeric)
        return score_isolation(prepare(df, self.prep), self.forest, name)


def save_forest(path: str, prep: PipelineModel, forest: Forest, numeric: list[str]) -> None:
    """Write preprocessing, node table and feature list below a path, which outlives the session."""
    spark = SparkSession.active()
    prep.save(f"{path}/prep")
    forest.nodes.write.option("compression", "zstd").parquet(f"{path}/nodes")
    sizes = spark.createDataFrame([(forest.trees, forest.rows_per_tree)], "trees int, rows_per_tree int")
    sizes.coalesce(1).write.json(f"{path}/sizes")
    listed = spark.createDataFrame(list(enumerate(numeric)), "position int, name string")
    listed.coalesce(1).write.json(f"{path}/numeric_features")


def load_forest(path: str) -> ForestBundle:
    """Read back what ``save_forest`` wrote."""
    spark = SparkSession.active()
    listed = spark.read.schema("position int, name string").json(f"{path}/numeric_features")
    numeric = [r["name"] for r in listed.orderBy("position").collect()]
    sizes = spark.read.schema("trees int, rows_per_tree int").json(f"{path}/sizes").first()
    forest = Forest(spark.read.parquet(f"{path}/nodes"), sizes["trees"], sizes["rows_per_tree"])
    return ForestBundle(PipelineModel.load(f"{path}/prep"), forest, numeric)
