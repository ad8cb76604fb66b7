"""Sources and sinks (survey §2.1).

``read_table`` dispatches on the extension (none -> csv, case-insensitive).
CSV delimiters are sniffed from the first line only (``, ; TAB |``: the first
that splits the header into more than one column wins).  Derived datasets are
written as Parquet under ``{base}/{dataset_id}/{stage}`` with a one-row
manifest, so types survive (the reference re-parses CSV each stage).
"""
from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Delimiter candidates in the reference's order.
DELIMITERS = [",", ";", "\t", "|"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint dir (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()  # one line, not data
    line = first[0][0] if first else ""
    for d in DELIMITERS:
        if len(line.split(d)) > 1:
            return d
    return ","


def read_csv_auto(spark: SparkSession, path: str, infer_schema: bool = True) -> DataFrame:
    sep = sniff_delimiter(spark, path)
    return spark.read.csv(path, header=True, inferSchema=infer_schema, sep=sep)


def read_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON lines, or (``multiline=True``) one array of records per file."""
    if multiline is None:
        head = spark.read.text(path).limit(1).collect()
        multiline = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.option("multiLine", bool(multiline)).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension: .parquet, .json/.jsonl, else (incl. none) CSV-like."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".parquet", ".pq"):
        return read_parquet(spark, path)
    if ext in (".json", ".jsonl"):
        return read_json(spark, path)
    if ext in (".xlsx", ".xls"):
        raise ValueError("Excel is not supported: convert to CSV or Parquet")
    return read_csv_auto(spark, path)


def write_versioned(df: DataFrame, base: str, dataset_id: str, stage: str) -> DataFrame:
    """Write ``df`` to ``base/dataset_id/stage`` (Parquet, overwrite) and return a manifest row."""
    spark = df.sparkSession
    path = os.path.join(base, str(dataset_id), stage)
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    n = written.count()  # parquet footers: cheap
    schema = T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("stage", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("row_count", T.LongType()),
                           T.StructField("col_count", T.LongType()), T.StructField("written_at", T.TimestampType())])
    return spark.createDataFrame([(str(dataset_id), stage, path, n, len(written.columns),
                                   _dt.datetime.now(_dt.timezone.utc))], schema)


def stream_prediction_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                          max_files_per_trigger: int | None = None) -> DataFrame:
    """The prediction log folder as an append-only streaming source."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)
