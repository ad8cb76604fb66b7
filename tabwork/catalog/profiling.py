"""Profiling queries (§2.4) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .inputs import (LINEITEM_DIRTY_COLS, LINEITEM_DIRTY_SQL, LINEITEM_DUPS_SQL,
                     lineitem_dirty, lineitem_with_dups, rounded)

T_SQL = f"({LINEITEM_DIRTY_SQL}) t"


def _columns_sql(cols=None, src=None) -> str:
    cols = cols or LINEITEM_DIRTY_COLS
    T_SQL = src or globals()["T_SQL"]
    parts = []
    for pos, (c, dtype, kind) in enumerate(cols):
        if kind == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            stats = (f"avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS mn, max({x}) AS mx, "
                     f"CASE WHEN stddev_samp({x}) > 0 THEN skewness({x}) WHEN stddev_samp({x}) = 0 AND count({c}) >= 3 THEN 0.0 END AS skewness, "
                     f"CASE WHEN stddev_samp({x}) > 0 THEN kurtosis({x}) WHEN stddev_samp({x}) = 0 AND count({c}) >= 4 THEN 0.0 END AS kurtosis, "
                     "NULL::VARCHAR AS dt_min, NULL::VARCHAR AS dt_max, "
                     "'numeric' AS inferred_type")
        elif kind == "datetime":
            stats = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, "
                     "NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis, "
                     f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS dt_min, "
                     f"strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS dt_max, 'datetime' AS inferred_type")
        else:
            ts = (f"CASE WHEN regexp_matches(trim({c}), '{P.DATE_SHAPE}') "
                  f"THEN try_cast(trim({c}) AS TIMESTAMP) END")
            is_dt = f"(count({c}) > 0 AND count({ts}) = count({c}))"
            stats = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, "
                     "NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis, "
                     f"CASE WHEN {is_dt} THEN strftime(min({ts}), '%Y-%m-%d %H:%M:%S') END AS dt_min, "
                     f"CASE WHEN {is_dt} THEN strftime(max({ts}), '%Y-%m-%d %H:%M:%S') END AS dt_max, "
                     f"CASE WHEN {is_dt} THEN 'datetime' WHEN avg(length({c})) > 50 THEN 'text' "
                     "ELSE 'categorical' END AS inferred_type")
        parts.append(
            f"SELECT '{c}' AS column_name, CAST({pos} AS BIGINT) AS position, '{dtype}' AS dtype, "
            f"count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
            f"count(DISTINCT {c}) AS unique_count, {stats} FROM {T_SQL}")
    body = " UNION ALL ".join(parts)
    return f"""
SELECT column_name, position, dtype, inferred_type, n_rows, n_missing,
       round(n_missing / n_rows, 5) AS missing_pct, unique_count,
       round(mean, 5) AS mean, round(std, 5) AS std, round(mn, 5) AS min, round(mx, 5) AS max,
       round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, dt_min, dt_max,
       concat_ws('|',
         CASE WHEN n_missing / n_rows > 0.3 THEN 'High missing values' END,
         CASE WHEN inferred_type = 'numeric' AND std < 0.01 AND unique_count > 1 THEN 'Near-zero variance' END,
         CASE WHEN unique_count / n_rows > 0.95 AND inferred_type <> 'numeric' THEN 'High cardinality' END
       ) AS warnings
FROM ({body})"""


def q_profile_columns(spark, d):
    out = P.profile_columns(lineitem_dirty(spark, d))
    return rounded(out.withColumn("warnings", F.concat_ws("|", "warnings")))


def q_profile_dataset(spark, d):
    return rounded(P.profile_dataset(lineitem_with_dups(spark, d)))


def _dataset_sql():
    strs = [c for c, _, k in LINEITEM_DIRTY_COLS if k == "string"]
    ncol = len(LINEITEM_DIRTY_COLS)
    miss = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c, _, _ in LINEITEM_DIRTY_COLS)
    size = " + ".join([f"coalesce(strlen({c}), 0) + 49" for c in strs]
                      + ["8"] * (ncol - len(strs)) + ["128"])
    cols = ", ".join(c for c, _, _ in LINEITEM_DIRTY_COLS)
    return f"""
WITH t AS ({LINEITEM_DUPS_SQL}),
g AS (SELECT count(*) AS c FROM t GROUP BY {cols})
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({ncol} AS BIGINT) AS col_count,
       CAST((SELECT sum(c - 1) FROM g) AS BIGINT) AS duplicate_rows,
       CAST(sum({miss}) AS BIGINT) AS missing_cells,
       round(sum({miss}) / (count(*) * {ncol}), 5) AS missing_pct,
       round(sum({size}) / 1048576.0, 5) AS memory_mb
FROM t"""


def q_profile_missing(spark, d):
    return rounded(P.profile_missing(lineitem_dirty(spark, d)))


def _missing_sql():
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
             f"round((count(*) - count({c})) / count(*), 5) AS missing_pct FROM {T_SQL}"
             for c, _, _ in LINEITEM_DIRTY_COLS]
    return " UNION ALL ".join(parts)


def q_profile_unique(spark, d):
    return P.profile_unique(lineitem_dirty(spark, d))


def _unique_sql():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM {T_SQL}"
        for c, _, _ in LINEITEM_DIRTY_COLS)


def q_profile_top_values(spark, d):
    df = lineitem_dirty(spark, d).select("l_returnflag", "l_linestatus", "first_flag",
                                         "l_linenumber", "ship_str")
    return P.profile_top_values(df, k=5).select("column_name", "value", "count",
                                                F.col("rank").cast("long").alias("rank"))


def _top_sql():
    cols = ["l_returnflag", "l_linestatus", "first_flag", "l_linenumber", "ship_str"]
    vc = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count "
        f"FROM {T_SQL} WHERE {c} IS NOT NULL GROUP BY 2" for c in cols)
    return f"""
SELECT column_name, value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM ({vc})) WHERE rank <= 5"""


NUM_HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "tiny_disc"]


def q_profile_histogram(spark, d):
    df = lineitem_dirty(spark, d)
    return rounded(P.profile_histogram(df, bins=10, columns=NUM_HIST))


def _hist_sql():
    parts = []
    for c in NUM_HIST:
        parts.append(f"""
SELECT '{c}' AS column_name, v FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {T_SQL}) WHERE v IS NOT NULL""")
    long = " UNION ALL ".join(parts)
    return f"""
WITH long AS ({long}),
rng AS (SELECT column_name,
          CASE WHEN max(v) > min(v) THEN min(v) ELSE min(v) - 0.5 END AS lo0,
          CASE WHEN max(v) > min(v) THEN max(v) ELSE max(v) + 0.5 END AS hi0
        FROM long GROUP BY column_name),
cnt AS (SELECT l.column_name, least(CAST(floor((v - lo0) * 10.0 / (hi0 - lo0)) AS BIGINT), 9) AS bin,
               count(*) AS c
        FROM long l JOIN rng r ON l.column_name = r.column_name GROUP BY 1, 2),
grid AS (SELECT column_name, lo0, hi0, CAST(b AS BIGINT) AS bin FROM rng, range(10) t(b))
SELECT g.column_name, g.bin, round(lo0 + g.bin * ((hi0 - lo0) / 10.0), 5) AS lo,
       round(lo0 + (g.bin + 1) * ((hi0 - lo0) / 10.0), 5) AS hi,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt ON g.column_name = cnt.column_name AND g.bin = cnt.bin"""


QUANT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_profile_quantiles(spark, d):
    return rounded(P.profile_quantiles(lineitem_dirty(spark, d), QUANT_COLS))


def _quant_sql():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {p} AS p, round(quantile_cont({c}, {p}), 5) AS value FROM {T_SQL}"
        for c in QUANT_COLS for p in (0.25, 0.5, 0.75))


def q_profile_numeric_stats(spark, d):
    return (q_profile_columns(spark, d).where(F.col("inferred_type") == "numeric")
            .select("column_name", "mean", "std", "min", "max", "skewness", "kurtosis"))


def q_profile_infer_type(spark, d):
    return q_profile_columns(spark, d).select("column_name", "dtype", "inferred_type")


def q_profile_warnings(spark, d):
    return q_profile_columns(spark, d).select("column_name", "warnings")


def q_profile_datetime_range(spark, d):
    return P.profile_datetime_range(lineitem_dirty(spark, d))


QUERIES = {
    "profile_columns": q_profile_columns,
    "profile_dataset": q_profile_dataset,
    "profile_missing": q_profile_missing,
    "profile_unique": q_profile_unique,
    "profile_top_values": q_profile_top_values,
    "profile_histogram": q_profile_histogram,
    "profile_quantiles": q_profile_quantiles,
    "profile_numeric_stats": q_profile_numeric_stats,
    "profile_infer_type": q_profile_infer_type,
    "profile_warnings": q_profile_warnings,
    "profile_datetime_range": q_profile_datetime_range,
}

_COLS = _columns_sql()
ORACLE = {
    "profile_columns": _COLS,
    "profile_dataset": _dataset_sql(),
    "profile_missing": _missing_sql(),
    "profile_unique": _unique_sql(),
    "profile_top_values": _top_sql(),
    "profile_histogram": _hist_sql(),
    "profile_quantiles": _quant_sql(),
    "profile_numeric_stats": f"SELECT column_name, mean, std, min, max, skewness, kurtosis FROM ({_COLS}) WHERE inferred_type = 'numeric'",
    "profile_infer_type": f"SELECT column_name, dtype, inferred_type FROM ({_COLS})",
    "profile_warnings": f"SELECT column_name, warnings FROM ({_COLS})",
    "profile_datetime_range": f"SELECT column_name, dt_min, dt_max FROM ({_COLS}) WHERE inferred_type = 'datetime'",
}
