"""Streams: cases as they arrive, scored and turned into alerts; stores that are written once however often a batch comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import raise_alerts


def read_cases(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 40) -> DataFrame:
    """A stream over a folder of Parquet files, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(cases: DataFrame, delay: str = "7 days") -> DataFrame:
    """Without repeated deliveries of a case; state older than the delay behind the newest time is let go."""
    return cases.withWatermark("analyzed_at", delay).dropDuplicatesWithinWatermark(["email_id"])


def alerts(cases: DataFrame, threshold: int = 70) -> DataFrame:
    return raise_alerts(unique(cases), threshold)


def start(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Runs a stream into a sink by micro-batches. The sink gets the batch's number, to write each batch once only."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="300 seconds").start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number, so that a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def bursts(cases: DataFrame, length: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Cases by campaign and time window. An extension: nothing of the kind is computed in batches."""
    return cases.withWatermark("analyzed_at", delay).groupBy(F.window("analyzed_at", length), "campaign_id").agg(F.count("*").alias("n"), F.max("risk").alias("max_risk"))


def sweep_sink(spark: SparkSession, retention_path: str, purged_path: str) -> Callable[[DataFrame, int], None]:
    """A sink that, at each trigger, writes which cases are due by the newest time of the batch."""
    from ..operators.retention import due

    def write(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("analyzed_at")).first()[0]
        if now is not None:
            due(spark.read.parquet(retention_path), F.lit(now)).select("email_id").write.mode("overwrite").parquet(f"{purged_path}/batch={number}")

    return write
