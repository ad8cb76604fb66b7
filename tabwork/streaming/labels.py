"""Ground-truth labels as a stream, merged into the static prediction log (survey §2.13, §2.15).

The label stream keeps the newest label per prediction id in the state store
(streaming aggregation, update mode).  Each micro-batch's changed rows are
written as a new versioned part under the checkpoint folder; the current view
is the newest label per id over all parts, left-joined onto the static log.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitor import record_ground_truth
from .monitor import stream_dirs


def latest_labels_stream(spark: SparkSession, labels_dir: str, schema, max_files_per_trigger: int = 1) -> str:
    """Run the label stream to completion; returns the folder of merged label parts."""
    out, ckpt = stream_dirs(spark, "labels")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(labels_dir)
    agg = src.groupBy("prediction_id").agg(
        F.max_by("ground_truth", F.struct("recorded_at", "ground_truth")).alias("ground_truth"),
        F.max("recorded_at").alias("recorded_at"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def record_ground_truth_stream(spark: SparkSession, log: DataFrame, labels_dir: str, schema) -> DataFrame:
    """Updated log after all label files were streamed in (newest label wins)."""
    parts = latest_labels_stream(spark, labels_dir, schema)
    labels = spark.read.parquet(parts).select("prediction_id", "ground_truth", "recorded_at")
    updated, _ = record_ground_truth(log, labels)
    return updated
