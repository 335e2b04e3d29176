"""Resumable sweeps: only what has no result yet is measured.

Batch form: an anti-join with the results.  Streaming form: a file source with a
checkpoint and ``availableNow``, which takes the new files and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unmeasured(work: DataFrame, results: DataFrame, key: str = "name") -> DataFrame:
    """Work items without a result; a result row with an error does not count."""
    done = results.where("error is null") if "error" in results.columns else results
    return work.join(done.select(key).distinct(), key, "left_anti")


def sweep(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame]) -> int:
    """Measure the Parquet files that came since the last sweep; returns the batches run.

    Each batch is written under its number, so a batch that runs again after a
    lost executor or driver replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and means per window and type; on a stream, rows later than the watermark are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
