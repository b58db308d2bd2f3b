"""Impute, scale and encode features with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.ranking import ROWS_PER_RANGE, prefix_sum
from fleetwatch.sources.tables import feature_columns

FEATURES = "features"


def most_frequent(df: DataFrame, column: str) -> str | None:
    """Most frequent value, the smallest one among equals; NULL does not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.orderBy(F.desc("count"), column).limit(1).collect()
    return top[0][0] if top else None


def exact_medians(df: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE) -> dict[str, float]:
    """Median of each column's present values (the mean of the two middle ones); 0 where there is none.

    All columns are one table of (column, value, count), ranked in one pass by ranges of bounded size.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = prefix_sum(counts, "value", ["n"], by=["column"], rows_per_range=rows_per_range).rows
    sizes = dict(ranked.groupBy("column").agg(F.max("cum_n")).collect())
    if not sizes:
        return dict.fromkeys(columns, 0.0)
    sized = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("column")]
    middle = [F.floor((sized - 1) / 2), F.floor(sized / 2)]
    at = [
        F.max(F.when((F.col("cum_n") - F.col("n") <= r) & (F.col("cum_n") > r), F.col("value"))) for r in middle
    ]
    found = ranked.groupBy("column").agg(((at[0] + at[1]) / 2).alias("median")).collect()
    return dict.fromkeys(columns, 0.0) | {r["column"]: r["median"] for r in found}


def prep_pipeline(
    numeric: list[str], categorical: list[str], fill: dict[str, str], medians: dict[str, float]
) -> Pipeline:
    """Median impute and standardise numbers; fill and one-hot encode texts, unknown text as zeros.

    ``fill`` and ``medians`` hold the values for missing texts and numbers. The scaler divides by the sample
    deviation.
    """
    filled_numbers = [f"{c}__filled" for c in numeric]
    present = ", ".join(
        f"CASE WHEN isnan({c}) THEN {medians[c]!r}D ELSE coalesce({c}, {medians[c]!r}D) END AS {c}__filled"
        for c in numeric
    )
    stages = [
        SQLTransformer(statement=f"SELECT *, {present} FROM __THIS__"),
        VectorAssembler(inputCols=filled_numbers, outputCol="numbers__raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="numbers__raw", outputCol="numbers__scaled"),
    ]
    parts = ["numbers__scaled"]
    for c in categorical:
        value = (fill.get(c) or "").replace("\\", "\\\\").replace("'", "\\'")
        stages += [
            SQLTransformer(statement=f"SELECT *, coalesce({c}, '{value}') AS {c}__filled FROM __THIS__"),
            StringIndexer(
                inputCol=f"{c}__filled",
                outputCol=f"{c}__index",
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            # The indexer gives unknown text the last index, and the last place is dropped: all zeros.
            OneHotEncoder(inputCols=[f"{c}__index"], outputCols=[f"{c}__onehot"], dropLast=True),
        ]
        parts.append(f"{c}__onehot")
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return Pipeline(stages=stages)


def fit_prep(df: DataFrame) -> PipelineModel:
    """Fit the preprocessing on the inputs the table has."""
    numeric, categorical = feature_columns(df.columns)
    fill = {c: most_frequent(df, c) for c in categorical}
    return prep_pipeline(numeric, categorical, fill, exact_medians(df, numeric)).fit(df)


def prepare(df: DataFrame, prep: PipelineModel) -> DataFrame:
    """The table with its feature vector, without the helper columns."""
    made = prep.transform(df)
    return made.drop(*[c for c in made.columns if "__" in c and c not in df.columns])


def vector_names(prep: PipelineModel, numeric: list[str]) -> list[str]:
    """Name of each place in the feature vector: the numbers, then one place per known text."""
    names = list(numeric)
    for stage in prep.stages:
        if hasattr(stage, "labels"):
            column = stage.getInputCol().removesuffix("__filled")
            names += [f"{column}_{v}" for v in stage.labels]
    return names
