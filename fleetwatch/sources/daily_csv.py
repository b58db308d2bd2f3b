"""Daily CSV files whose header changes over time, read as one table of text."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = "filename"


def _headers(spark: SparkSession, root: str) -> dict[tuple[str, ...], list[str]]:
    """Files under ``root`` by header.

    One distributed job keeps the first line of the first block of each file; the driver receives one
    line per file, no more than the file listing it holds anyway.
    """
    try:
        lines = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.csv")
            .text(root)
            .select("value", F.col("_metadata.file_path").alias("path"), "_metadata.file_block_start")
            .where("file_block_start = 0")
            .groupBy("path")
            .agg(F.first("value").alias("header"))
            .collect()
        )
    except AnalysisException as missing:
        raise FileNotFoundError(f"no CSV files under {root}") from missing
    if not lines:
        raise FileNotFoundError(f"no CSV files under {root}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in lines:
        names = tuple(next(csv.reader(io.StringIO(header.lstrip("\ufeff")))))
        groups.setdefault(names, []).append(path)
    return groups


def read_daily_csv(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """All ``*.csv`` below ``root``, aligned by column name, every field text, empty text as NULL.

    Files are read once per distinct header, because one reader over mixed headers would align by
    position. A row that does not fit its header raises when the rows are read. ``filename`` names the
    source file.
    """
    parts = []
    for names, paths in sorted(_headers(spark, root).items()):
        if len(set(names)) != len(names):
            raise ValueError(f"repeated column in the header of {sorted(paths)[0]}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = (
            spark.read.schema(schema)
            .option("header", "true")
            .option("mode", "FAILFAST")
            # A pruned reader would not see that a row has too few or too many fields.
            .option("columnPruning", "false")
            .option("escape", '"')
            .option("multiLine", str(multi_line).lower())
            .csv(sorted(paths))
        )
        fields = [F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]
        parts.append(part.select(*fields, F.col("_metadata.file_path").alias(PROVENANCE)))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return table.select(*[c for c in table.columns if c != PROVENANCE], PROVENANCE)
