"""Session settings and the shared folder for tables that cut a long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(cores: str = "*", app: str = "fleetwatch", **extra: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        # Call sites are recorded per column expression, which costs more than planning wide tables.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it.

    A session whose driver is its only executor, and which names none, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT, None) or _local_folders.get(context.applicationId)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that all executors share")
        folder = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="fleetwatch-")
    return f"{folder.rstrip('/')}/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def mark(spark: SparkSession) -> int:
    """How many paths this application has made; ``release`` takes it."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what ``new_path`` and ``cut`` have made since ``mark``, but for the paths to keep.

    Frames that still read these tables cannot be read afterwards.
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = [p for p in made[since:] if p in keep]
    for path in made[since:]:
        if path not in keep:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    made[since:] = left


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage, survives lost executors, freezes row ids, and tells Catalyst the real size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
