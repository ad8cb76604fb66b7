"""Feature plan (survey §2.9): rules over the profile frame -> spec frame."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the reference feature planner.
ID_LIKE = 0.9
SKEW_LOG = 2.0
ONE_HOT_MAX = 15
LABEL_MEDIUM_MAX = 50


def feature_plan(profile_cols: DataFrame, target: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """One spec per column: ID-like disabled; log if |skew| > 2 else scale; one-hot
    ≤ 15 categories, label otherwise; date parts; booleans kept.  Columns in
    ``exclude`` (e.g. PII dropped earlier, quirk Q9) and the target get no spec."""
    p = profile_cols.where(~F.col("column_name").isin([target] if target else []) &
                           ~F.col("column_name").isin(list(exclude) or [""]))
    it = F.col("inferred_type")
    name = F.col("column_name")
    ratio = F.col("unique_count") / F.greatest(F.col("n_rows"), F.lit(1))
    uc = F.col("unique_count")
    sk = F.col("skewness")
    id_like = it.isin("categorical", "text") & (ratio > ID_LIKE)
    log = (it == "numeric") & sk.isNotNull() & (F.abs(sk) > SKEW_LOG)
    transform = (F.when(id_like, "none").when(log, "log").when(it == "numeric", "standard_scale")
                 .when((it == "categorical") & (uc <= ONE_HOT_MAX), "one_hot_encode")
                 .when(it == "categorical", "label_encode").when(it == "datetime", "date_parts")
                 .when(it == "boolean", "none"))
    output = (F.when(id_like, name).when(log, F.concat(name, F.lit("_log")))
              .when(it == "datetime", F.concat(name, F.lit("_parts"))).otherwise(name))
    dtype_out = (F.when(id_like, F.col("dtype")).when(it == "numeric", "float64").otherwise("int64"))
    note = (F.when(id_like, "High cardinality — likely an ID column. Disabled by default.")
            .when(log, F.format_string("Skewness=%.2f → log transform recommended", sk))
            .when(it == "numeric", "Numeric — standard scaling")
            .when((it == "categorical") & (uc <= ONE_HOT_MAX), F.format_string("Low cardinality (%d) → one-hot encode", uc))
            .when((it == "categorical") & (uc <= LABEL_MEDIUM_MAX), F.format_string("Medium cardinality (%d) → label encode", uc))
            .when(it == "categorical", F.format_string("High cardinality (%d) → label encode (consider target encode)", uc))
            .when(it == "datetime", "Datetime → extract year/month/day/dayofweek")
            .when(it == "boolean", "Boolean — keep as-is"))
    return p.select(F.concat_ws(":", F.lit("feature"), name).alias("spec_id"), "position",
                    name.alias("source_column"), output.alias("output_name"), transform.alias("transform"),
                    F.col("dtype").alias("dtype_in"), dtype_out.alias("dtype_out"),
                    (~id_like).alias("enabled"), note.alias("note")).where(F.col("transform").isNotNull())
