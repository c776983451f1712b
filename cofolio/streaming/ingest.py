"""Incremental ingest of landed list entries with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofolio.operators.ratings import rated

SCHEMA = "user_id long, item_id long, score double, ts timestamp, event_id long"


def merge_batch(out: str):
    """A ``foreachBatch`` function: the latest rated entry of each pair of the batch goes to ``out/batch=<id>``.

    A batch that is run again overwrites its own folder, so nothing counts twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        last = rated(batch).groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id", "score")).alias("last"))
        last.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 2) -> None:
    """Take in all files that landed since the last call."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = stream.writeStream.foreachBatch(merge_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """``user_id, item_id, raw_score``: the latest entry of each pair over all batches."""
    parts = spark.read.parquet(out)
    return parts.groupBy("user_id", "item_id").agg(F.max("last").alias("last")).select("user_id", "item_id", F.col("last.score").alias("raw_score"))
