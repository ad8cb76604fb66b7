"""Streaming queries: each copies a driver table into a log folder (several
files, as a serving tier would append them) and runs the stream over it."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources.io import scratch_path
from ..streaming import monitor as SM
from .privacy import _redact_sql


def _log_folder(spark, d, name, n_files=4, time_col=None):
    """Copy a table into a log folder of ``n_files`` files; with ``time_col`` the files are
    time ranges written in order (as a serving tier appends them), else round-robin."""
    df = table(spark, d, name)
    path = scratch_path(spark, f"log-{name}")
    if time_col:
        ranged = df.repartitionByRange(n_files, time_col).withColumn("__range", F.spark_partition_id())
        ranged = ranged.persist()
        for i in range(n_files):  # one after the other, so that file times follow the rows' times
            ranged.where(F.col("__range") == i).drop("__range").coalesce(1).write.mode("append").parquet(path)
        ranged.unpersist()
    else:
        df.repartition(n_files).write.parquet(path)
    return path, df.schema


def q_monitor_volume_stream(spark, d):
    path, schema = _log_folder(spark, d, "events", time_col="ts")
    out = SM.monitor_volume_stream(spark, path, schema, ts_col="ts")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "count")


def q_stream_prediction_log(spark, d):
    """The log folder as a stream: rows per event type after all files are processed."""
    path, schema = _log_folder(spark, d, "events")
    out, ckpt = SM.stream_dirs(spark, "log")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    agg = src.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("value_sum"))
    SM.run_update_to_parquet(agg, out, ckpt)
    return SM.newest_groups(spark, out, ["event_type"])


def q_pii_text_redact_stream(spark, d):
    path, schema = _log_folder(spark, d, "documents")
    out = SM.pii_redact_stream(spark, path, schema, "text", keep=["doc_id"])
    return out.withColumn("redacted", F.sha2("redacted", 256))


def q_record_ground_truth_stream(spark, d):
    from .monitoring import label_batch, prediction_log
    from ..streaming.labels import record_ground_truth_stream
    labels = label_batch(spark, d)
    path = scratch_path(spark, "labels")
    labels.repartition(4).write.parquet(path)
    out = record_ground_truth_stream(spark, prediction_log(spark, d), path, labels.schema)
    return out.select("prediction_id", "ground_truth")


QUERIES = {
    "record_ground_truth_stream": q_record_ground_truth_stream,
    "monitor_volume_stream": q_monitor_volume_stream,
    "stream_prediction_log": q_stream_prediction_log,
    "pii_text_redact_stream": q_pii_text_redact_stream,
}

def _rgt_sql():
    from .monitoring import RGT_SQL
    return RGT_SQL


ORACLE = {
    "record_ground_truth_stream": _rgt_sql(),
    "monitor_volume_stream": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS count
FROM events GROUP BY 1""",
    "stream_prediction_log": "SELECT event_type, count(*) AS n, round(sum(value), 5) AS value_sum FROM events GROUP BY 1",
    "pii_text_redact_stream": _redact_sql("documents", "doc_id", "text"),
}
