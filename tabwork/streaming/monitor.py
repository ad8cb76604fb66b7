"""Streaming forms of the monitoring operators (survey §2.13, §2.15).

Streams read an append-only folder (the prediction log), run with the
``availableNow`` trigger (process what is there, then stop — the same code
runs continuously with a processing-time trigger) and keep their checkpoint
under the session's ``spark.checkpoint.dir`` so a restarted job resumes
exactly where it stopped.  Timestamps are cast from NTZ to TIMESTAMP (UTC
session) because watermarks need the zoned type.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pii as PII
from ..session import ensure_checkpoint_dir


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def hourly_volume(stream: DataFrame, ts_col: str = "created_at", watermark: str = "1 hour",
                  by: list[str] = ()) -> DataFrame:
    """Tumbling 1-hour counts with a watermark (late rows beyond it are dropped in append mode)."""
    s = stream.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
    return s.groupBy(F.window("__ts", "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))


def run_update_to_parquet(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an aggregating stream to completion.

    Each micro-batch writes only the groups it changed, as a part named by its epoch: a repeated
    batch replaces its own part, and a crash never leaves the table empty.  Groups behind the
    watermark leave the state.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def newest_groups(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """The current result: every group's row of its newest epoch."""
    parts = spark.read.parquet(out_path)
    rest = [c for c in parts.columns if c not in (*keys, "epoch")]
    newest = parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__newest"))
    return newest.select(*keys, "__newest.*")


def run_append_to_parquet(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def monitor_volume_stream(spark: SparkSession, log_dir: str, schema, ts_col: str = "created_at",
                          max_files_per_trigger: int = 1, watermark: str = "1 hour") -> DataFrame:
    """Hourly volume of a prediction-log folder as a stream; returns the final result table.

    Rows that come later than the watermark allows are dropped, as their window has left the state.
    """
    out, ckpt = stream_dirs(spark, "volume")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_dir)
    run_update_to_parquet(hourly_volume(src, ts_col, watermark), out, ckpt)
    return newest_groups(spark, out, ["w"])


def pii_redact_stream(spark: SparkSession, src_dir: str, schema, text_col: str, keep: list[str],
                      max_files_per_trigger: int = 1) -> DataFrame:
    """Stateless redaction of a text stream (counts + redacted text), appended to Parquet."""
    out, ckpt = stream_dirs(spark, "redact")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src_dir)
    run_append_to_parquet(PII.pii_text_redact(src, text_col, keep=keep), out, ckpt)
    return spark.read.parquet(out)
