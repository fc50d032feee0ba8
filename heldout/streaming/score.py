"""Scoring a stream of samples, and an exactly-once ledger of what was scored.

Scoring needs nothing but the frozen model, so the stream is a stateless projection and gives what the batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.operators.model import score
from heldout.sources.sinks import path_exists


def read_sample_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of sample rows as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_score(samples: DataFrame, model: DataFrame, features: int, path: str, checkpoint: str):
    """Score the stream with one frozen model into a Parquet table; each row is written exactly once."""
    scored = score(samples, model, features, left_out=False).select("id", "grp", "pred")
    return (
        scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def stream_ledger(scored: DataFrame, path: str, checkpoint: str):
    """One ledger row per micro-batch and group. A batch that is run again replaces its own folder, so rows never double."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("pred_sum"))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a stream ledger."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "grp string, n long, pred_sum double, batch_id int")
    return spark.read.parquet(path)
