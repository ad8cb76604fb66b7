"""Column detection (survey §2.2): numeric, text and date columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_datetime, is_numeric, q
from .profile import parsed_timestamp

# Thresholds of the reference.
MIN_AVG_WORDS = 3.0
DATE_PARSE_SHARE = 0.7


def numeric_columns_frame(df: DataFrame) -> DataFrame:
    """Numeric columns (``select_dtypes(number)``) with their position, type and non-null count."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, position int, dtype string, n_non_null long")
    wide = df.agg(*[F.count(F.col(q(f.name))).alias(f"n{i}") for i, f in fields])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").cast("long").alias("n_non_null"))
        for i, f in fields])).alias("s")).select("s.*")


def detect_text_columns(df: DataFrame, exclude: str | None = None, min_avg_words: float = MIN_AVG_WORDS) -> DataFrame:
    """String columns whose non-null values average at least ``min_avg_words`` words (all rows, one aggregate)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != exclude]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, avg_words double, is_text boolean")
    wide = df.agg(*[F.avg(F.size(F.split(F.trim(F.col(q(c))), r"\s+"))).alias(f"w{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"w{i}").cast("double")
                                                    .alias("avg_words")) for i, c in enumerate(cols)])).alias("s"))
    return long.select("s.*").withColumn("is_text", F.coalesce(F.col("avg_words") >= min_avg_words, F.lit(False)))


def detect_date_column(df: DataFrame, exclude: str | None = None, share: float = DATE_PARSE_SHARE) -> DataFrame:
    """First datetime-typed column; else the first string column with > 70 % of values parseable."""
    for f in df.schema.fields:
        if f.name != exclude and is_datetime(f.dataType):
            return df.sparkSession.createDataFrame([(f.name, 1.0)], "column_name string, parse_share double")
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != exclude]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, parse_share double")
    wide = df.agg(*[(F.count(parsed_timestamp(F.col(q(c)))) / F.count(F.col(q(c)))).alias(f"s{i}")
                    for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"),
                                                    F.col(f"s{i}").cast("double").alias("parse_share"))
                                           for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return (long.where(F.col("parse_share") > share).orderBy("pos").limit(1)
            .select("column_name", "parse_share"))
