"""Session helpers: reading the tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables. Only Spark's reader touches the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is named, a temporary one is set on a local master;
    elsewhere executors wouldn't share it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: what df holds is written to the shared folder once and read from there.

    It survives the loss of executors, unlike a cached or locally checkpointed table.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch; a smaller bound is left. Its bytes are bounded by Spark, at 64 MB by default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
