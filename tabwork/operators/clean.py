"""Applying cleaning actions (survey §2.7) as one lazy plan.

Actions run in order.  Statistics they need (mean, median, quartiles) are
gathered in one aggregate per *stage*; a stage ends at an action that removes
rows (dedupe, outlier removal, dropping null rows) or when an action needs
statistics of a column an earlier action in the same stage changed.  Mode is a
grouped count + top-1 (distributed, no per-value map in one buffer).
Unknown strategies and missing columns raise before anything runs (quirk Q17).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_quantiles, nan_to_null, q
from ..functions.ordered import fill_nulls_ordered
from .impute import knn_impute

STRATEGIES = {"drop_column", "mean_impute", "median_impute", "mode_impute", "forward_fill",
              "backward_fill", "constant_fill", "clip_outliers", "remove_outliers", "drop_rows", "knn_impute", "none"}
ROW_REMOVING = {"remove_outliers", "drop_rows"}
NEEDS_STATS = {"mean_impute": ["mean"], "median_impute": ["median"], "clip_outliers": ["q1", "q3"],
               "remove_outliers": ["q1", "q3"], "mode_impute": ["mode"]}
IQR_K = 1.5


@dataclass
class Action:
    column: str
    strategy: str
    action_id: str = ""


def _as_actions(actions, overrides: dict | None) -> list[Action]:
    overrides = overrides or {}
    out = []
    for a in actions:
        if isinstance(a, Action):
            aid, col, strat = a.action_id, a.column, a.strategy
        else:
            d = a.asDict() if hasattr(a, "asDict") else dict(a)
            aid, col, strat = d.get("action_id", ""), d.get("column_name", d.get("column")), d["strategy"]
        strat = overrides.get(aid, strat)
        if strat not in STRATEGIES:
            raise ValueError(f"unknown cleaning strategy {strat!r}")
        out.append(Action(col, strat, aid))
    return out


def _stats(df: DataFrame, needs: dict[str, set]) -> dict:
    """One aggregate for mean/median/quartiles of all columns in the stage, plus top-1 counts for modes."""
    aggs = [F.avg(F.col(q(c))).alias(f"mean|{c}") for c, kinds in needs.items() if "mean" in kinds]
    res = {}
    if aggs:
        row = df.agg(*aggs).first().asDict()
        for k, v in row.items():
            res[(k.split("|", 1)[1], "mean")] = v
    qcols = [c for c, kinds in needs.items() if kinds & {"median", "q1", "q3"}]
    if qcols:
        qs = column_quantiles(df, qcols, [0.25, 0.5, 0.75])
        for c in qcols:
            res[(c, "q1")], res[(c, "median")], res[(c, "q3")] = qs[(c, 0.25)], qs[(c, 0.5)], qs[(c, 0.75)]
    for c, kinds in needs.items():
        if "mode" in kinds:
            top = (df.where(F.col(q(c)).isNotNull()).groupBy(F.col(q(c)).alias("v")).count()
                   .orderBy(F.desc("count"), F.asc("v")).limit(1).collect())
            res[(c, "mode")] = top[0]["v"] if top else None
    return res


def _bounds(st, c):
    q1, q3 = st.get((c, "q1")), st.get((c, "q3"))
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    return q1 - IQR_K * iqr, q3 + IQR_K * iqr


def clean_apply(df: DataFrame, actions, overrides: dict | None = None, order_by: str | None = None,
                partition_by: list[str] = (), checkpoint_stages: bool = False,
                persist_stages: bool = True) -> DataFrame:
    """Fold ``actions`` (plan rows or dicts with column/strategy) into ``df``.

    ``order_by`` (a unique numeric column) is required for forward/backward fill.
    ``checkpoint_stages`` cuts the lineage after every stage with a reliable
    ``checkpoint()`` into the session's ``spark.checkpoint.dir`` (shared storage),
    so a long plan does not recompute from the source after an executor loss.
    ``persist_stages`` writes a stage boundary as a Parquet table into that folder when the
    next stage needs statistics, so that e.g. a dedupe shuffle runs once, not once for each
    statistic and again for the result.
    """
    if checkpoint_stages:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
    acts = _as_actions(actions, overrides)
    df = nan_to_null(df)
    for a in acts:
        if a.column != "__all__" and a.column not in df.columns and a.strategy != "drop_column":
            raise ValueError(f"unknown column {a.column!r}")
        if a.strategy in ("forward_fill", "backward_fill") and not order_by:
            raise ValueError("forward/backward fill needs order_by")
    i = 0
    while i < len(acts):
        # gather a stage
        stage, needs, touched = [], {}, set()
        while i < len(acts):
            a = acts[i]
            kinds = set(NEEDS_STATS.get(a.strategy, []))
            if kinds and a.column in touched:
                break
            stage.append(a)
            if kinds:
                needs.setdefault(a.column, set()).update(kinds)
            touched.add(a.column)
            i += 1
            if a.strategy in ROW_REMOVING or a.column == "__all__":
                break
        live = {c: k for c, k in needs.items() if c in df.columns}
        if live and persist_stages and i > len(stage):
            from ..sources.io import scratch_path
            path = scratch_path(df.sparkSession, "clean-stage")
            df.write.parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        st = _stats(df, live) if live else {}
        for a in stage:
            df = _apply_one(df, a, st, order_by, list(partition_by))
        if checkpoint_stages and i < len(acts):
            df = df.checkpoint(eager=True)
    return df


def _apply_one(df: DataFrame, a: Action, st: dict, order_by, partition_by) -> DataFrame:
    c, s = a.column, a.strategy
    if c == "__all__":
        return df.dropDuplicates() if s == "drop_rows" else df
    if c not in df.columns:
        return df
    col = F.col(q(c))
    dtype = df.schema[c].dataType
    if s == "drop_column":
        return df.drop(c)
    if s in ("mean_impute", "median_impute", "mode_impute"):
        v = st.get((c, s.split("_")[0]))
        return df if v is None else df.withColumn(c, F.coalesce(col, F.lit(v).cast(dtype)))
    if s == "constant_fill":
        return df.withColumn(c, F.coalesce(col, F.lit(0).cast(dtype)))
    if s == "forward_fill":
        return fill_nulls_ordered(df, c, order_by, partition_by)
    if s == "backward_fill":
        return fill_nulls_ordered(df, c, order_by, partition_by, backward=True)
    if s == "clip_outliers":
        lo, hi = _bounds(st, c)
        if lo is None:
            return df
        clipped = F.when(col.isNull(), None).when(col < lo, F.lit(lo)).when(col > hi, F.lit(hi)).otherwise(col)
        return df.withColumn(c, clipped.cast(dtype) if dtype.typeName() in ("double", "float") else clipped)
    if s == "remove_outliers":
        lo, hi = _bounds(st, c)
        return df if lo is None else df.where((col >= lo) & (col <= hi))
    if s == "drop_rows":
        return df.dropna(subset=[c])
    if s == "knn_impute":
        return knn_impute(df, wanted=[c])
    return df


# single-strategy helpers (the keys of survey §2.7)
def clean_dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def strategy(df: DataFrame, column: str, name: str, **kw) -> DataFrame:
    return clean_apply(df, [Action(column, name)], **kw)


def stage_audit(before: DataFrame, after: DataFrame, actions=None) -> DataFrame:
    """Rows and columns before/after, removed counts and strategies used (one row)."""
    strategies = sorted({a.strategy for a in _as_actions(actions or [], None)})
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    nb, na = len(before.columns), len(after.columns)
    return (b.withColumn("__k", F.lit(0)).join(a.withColumn("__k", F.lit(0)), "__k").drop("__k")
            .select(F.col("rows_before").cast("long"), F.col("rows_after").cast("long"),
                    (F.col("rows_before") - F.col("rows_after")).cast("long").alias("rows_removed"),
                    F.lit(nb).cast("long").alias("cols_before"), F.lit(na).cast("long").alias("cols_after"),
                    F.lit(nb - na).cast("long").alias("cols_removed"),
                    F.lit(",".join(strategies)).alias("strategies")))
