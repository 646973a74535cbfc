"""Session helpers: a UTC session, table loading and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a staged table may be broadcast to the tasks that join it
BROADCAST_ROWS = 100_000
#: Setting of Spark by which a query deletes its shuffle files when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "threadloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"threadloom-{spark.sparkContext.applicationId}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and
    a branch that is read several times is computed once.  Files stay until ``discard`` or until the folder
    is cleaned.  Files are packed, so their size tells little about the rows; a table of more than
    ``BROADCAST_ROWS`` rows is joined by sorting, whatever its files take, and never broadcast for their size.
    The shuffle files of the write are deleted when it ends, so those of one step at a time are on the disks.
    """
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if seen.get["n"] > BROADCAST_ROWS:
        out = out.hint("merge")
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more, as the earlier rounds of a loop."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)  # noqa: SLF001
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001
