"""Cleaning plan (survey §2.7): rules over the profile frames -> action frame.

The plan is a small DataFrame (one row per action) computed lazily from the
profile; ``operators.clean.clean_apply`` takes it (or an edited list of
actions) and folds it into one lazy plan over the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the reference cleaning planner.
DROP_MISSING = 0.5
IMPUTE_MISSING = 0.05
HIGH_MISSING = 0.3
DUP_MEDIUM = 0.02
SKEW_CLIP = 3.0
SKEW_MEDIUM = 5.0

ACTION_COLS = ["action_id", "seq", "column_name", "issue_type", "issue_detail", "severity", "strategy",
               "affected_rows", "estimated_impact"]


def _action(seq, column, issue, detail, severity, strategy, affected, impact):
    return [F.concat_ws(":", F.lit(issue), column).alias("action_id"), seq.cast("long").alias("seq"),
            column.alias("column_name"), F.lit(issue).alias("issue_type"), detail.alias("issue_detail"),
            severity.alias("severity"), strategy.alias("strategy"), affected.cast("long").alias("affected_rows"),
            impact.alias("estimated_impact")]


def clean_plan(profile_cols: DataFrame, profile_ds: DataFrame) -> DataFrame:
    """Actions: dedupe; drop columns >50 % missing; median/mode impute >5 %;
    drop near-constant; drop high-cardinality categoricals; clip |skew| > 3.

    Every profile row emits an array of candidate actions (null when a rule
    does not fire) that is exploded once, so the profile is computed once.
    """
    n = F.col("n_rows")
    mp = F.col("missing_pct")
    name = F.col("column_name")
    pos = F.col("position")
    dup = F.col("duplicate_rows")

    def st(*cols):
        return F.struct(*cols)

    dups = profile_ds.where(dup > 0).select(*_action(
        F.lit(-1), F.lit("__all__"), "duplicates",
        F.concat(F.format_number(dup, 0), F.lit(" duplicate rows detected")),
        F.when(dup / F.greatest(F.col("row_count"), F.lit(1)) > DUP_MEDIUM, "medium").otherwise("low"),
        F.lit("drop_rows"), dup, F.concat(F.lit("Remove "), F.format_number(dup, 0), F.lit(" exact duplicate rows"))))
    affected = F.round(mp * n).cast("long")
    numeric = F.col("inferred_type") == "numeric"
    sk = F.col("skewness")
    rules = [
        (mp > DROP_MISSING, _action(
            pos * 10, name, "missing_values", F.format_string("%.1f%% missing — too high for imputation", mp * 100),
            F.lit("high"), F.lit("drop_column"), affected,
            F.format_string("Drop column '%s' (%.1f%% missing)", name, mp * 100))),
        ((mp > IMPUTE_MISSING) & (mp <= DROP_MISSING), _action(
            pos * 10, name, "missing_values", F.format_string("%.1f%% missing values", mp * 100),
            F.when(mp > HIGH_MISSING, "high").otherwise("medium"),
            F.when(numeric, "median_impute").otherwise("mode_impute"), affected,
            F.concat(F.lit("Impute "), F.format_number(affected, 0), F.lit(" missing values with "),
                     F.when(numeric, "median").otherwise("mode")))),
        (F.array_contains("warnings", "Near-zero variance"), _action(
            pos * 10 + 1, name, "low_variance", F.lit("Near-constant column — low predictive value"), F.lit("low"),
            F.lit("drop_column"), F.lit(0), F.format_string("Drop low-variance column '%s'", name))),
        (F.array_contains("warnings", "High cardinality") & F.col("inferred_type").isin("categorical", "text"),
         _action(pos * 10 + 2, name, "high_cardinality",
                 F.concat(F.format_number(F.col("unique_count"), 0), F.lit(" unique values — may cause overfitting")),
                 F.lit("medium"), F.lit("drop_column"), F.lit(0),
                 F.concat(F.lit("Drop high-cardinality column '"), name, F.lit("' ("),
                          F.format_number(F.col("unique_count"), 0), F.lit(" unique values)")))),
        (numeric & sk.isNotNull() & (F.abs(sk) > SKEW_CLIP), _action(
            pos * 10 + 3, name, "outliers", F.format_string("Skewness = %.2f — likely outliers present", sk),
            F.when(F.abs(sk) > SKEW_MEDIUM, "medium").otherwise("low"), F.lit("clip_outliers"),
            (n * 0.01).cast("long"),
            F.format_string("Clip extreme values in '%s' (skew=%.2f) to IQR bounds", name, sk))),
    ]
    cand = F.array(*[F.when(cond, st(*cols)) for cond, cols in rules])
    per_col = (profile_cols.select(F.explode(F.filter(cand, lambda x: x.isNotNull())).alias("a"))
               .select("a.*"))
    return dups.unionByName(per_col)


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.sum("affected_rows"), F.lit(0)).cast("long").alias("estimated_rows_affected"),
                    F.sum((F.col("strategy") == "drop_column").cast("long")).alias("estimated_cols_removed"))
