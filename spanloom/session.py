"""Session construction, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def local_session(cores: int | str = "*", app: str = "spanloom") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on, made in the session at hand.

    Spark 4.1 may take a union of two hash-partitioned inputs as hash-partitioned itself and
    then leave out the shuffle in front of a window or sort.  When adaptive execution
    coalesces the two inputs differently, rows of one key end up in separate tasks, so
    that inference is switched off.
    """
    if spark.version >= "4.1":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A session of one machine that names none gets a new temporary folder; a cluster
    without the setting is an error, as executors would each write to their own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside delete their shuffle files when they end: nothing reads those of a table that is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here, and the shuffles that made them are deleted.

    Columns are stored apart and compressed by zstandard (ids are often hex digests), so a later step reads those it
    needs, and its joins know how large the table is.  Each call writes a folder of its own.
    """
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark).rstrip('/')}/cut/{uuid.uuid4().hex}"
    untyped = [f.name for f in df.schema if isinstance(f.dataType, NullType)]
    kept = df.drop(*untyped)
    with shuffles_dropped(spark):
        kept.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = spark.read.schema(kept.schema).parquet(path)
    return out.withColumns({c: F.lit(None) for c in untyped}).select(*df.columns) if untyped else out
