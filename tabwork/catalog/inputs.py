"""Test inputs derived from the driver tables, in Spark and in DuckDB SQL.

The driver tables have no nulls and no duplicates, so nulls, NaN and
duplicates are injected the same way on both sides.  Every input reads a
whole table; nothing is filtered to make the check cheaper.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table


# Unique lineitem row id from all key columns (same text in Spark SQL and DuckDB);
# (l_orderkey, l_linenumber) alone repeats in the generated data.
LI_RID = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"


def rounded(df: DataFrame, nd: int = 5) -> DataFrame:
    """Round every float column (and print timestamps as text) for a stable value hash against DuckDB."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(c.cast("double"), nd) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# --- lineitem with missing values, a sparse column, string dates, a tiny-variance column
def lineitem_dirty(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(F.col("l_linenumber") >= 2, None).otherwise(F.col("l_returnflag")).alias("first_flag"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_str"),
        (F.col("l_discount") / 100).alias("tiny_disc"))


LINEITEM_DIRTY_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
       CASE WHEN l_linenumber >= 2 THEN NULL ELSE l_returnflag END AS first_flag,
       strftime(l_shipdate, '%Y-%m-%d') AS ship_str,
       l_discount / 100 AS tiny_disc
FROM lineitem"""

# (name, spark dtype string, kind) for lineitem_dirty, in schema order
LINEITEM_DIRTY_COLS = [
    ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
    ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
    ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
    ("l_returnflag", "string", "string"), ("l_linestatus", "string", "string"),
    ("l_shipdate", "timestamp_ntz", "datetime"), ("first_flag", "string", "string"),
    ("ship_str", "string", "string"), ("tiny_disc", "double", "numeric"),
]


# --- lineitem measures with values missing alone, together and in whole rows
GAPPY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_GAPS = {"l_quantity": "h % 211 = 0", "l_extendedprice": "h % 307 = 0 OR h % 401 = 1", "l_discount": "h % 401 < 2", "l_tax": "h % 503 = 0 OR h % 401 = 0"}
_GAPPY = ", ".join(f"CASE WHEN {_GAPS[c]} OR h % 1999 = 0 THEN NULL ELSE {c} END AS {c}" for c in GAPPY)
# the remainder of a product of the keys stands for a draw; the same text in both dialects
LINEITEM_GAPPY_SQL = f"SELECT rid, {_GAPPY} FROM (SELECT *, {LI_RID} AS rid, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000003 AS h FROM lineitem)"


def lineitem_gappy(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("rid", F.expr(LI_RID))
    return (li.withColumn("h", F.expr("(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000003"))
            .select("rid", *[F.expr(f"CASE WHEN {_GAPS[c]} OR h % 1999 = 0 THEN NULL ELSE {c} END").alias(c) for c in GAPPY]))


# --- lineitem with exact duplicate rows appended (every 7th line number repeated)
def lineitem_with_dups(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem_dirty(spark, d)
    return li.unionByName(li.where(F.col("l_linenumber") == 7))


LINEITEM_DUPS_SQL = f"""
SELECT * FROM ({LINEITEM_DIRTY_SQL}) UNION ALL
SELECT * FROM ({LINEITEM_DIRTY_SQL}) WHERE l_linenumber = 7"""


# --- scored rows from formulas (no model): binary
# (model name, Spark expression, DuckDB expression) for the raw score before clipping
# (model name, score formula valid in both Spark SQL and DuckDB)
BINARY_MODELS = [
    ("disc", "l_discount * 10"),
    ("tax", "l_tax * 12.5"),
    ("qty", "l_quantity / 50"),
    ("mix", "(l_discount * 10 + l_tax * 12.5) / 2"),
]


def scored_binary(spark: SparkSession, d: str, models=None) -> DataFrame:
    """id, label, probability, prediction, model, fold from the whole lineitem table.

    label = returned (R); each model scores a row by a formula clipped to [0, 1].
    """
    li = table(spark, d, "lineitem")
    ident = F.expr(LI_RID).alias("id")
    label = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label")
    fold = F.pmod(F.col("l_orderkey"), F.lit(5)).cast("long").alias("fold")
    out = None
    for name, expr in BINARY_MODELS:
        if models and name not in models:
            continue
        p = F.least(F.greatest(F.expr(expr), F.lit(0.0)), F.lit(1.0))
        part = li.select(ident, label, p.alias("probability"), F.lit(name).alias("model"), fold)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))


def scored_binary_sql(models=None) -> str:
    parts = []
    for name, sql in BINARY_MODELS:
        if models and name not in models:
            continue
        parts.append(f"""
  SELECT {LI_RID} AS id,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS label,
         least(greatest({sql}, 0.0), 1.0) AS probability, '{name}' AS model,
         CAST(l_orderkey % 5 AS BIGINT) AS fold
  FROM lineitem""")
    return ("SELECT *, CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction FROM ("
            + " UNION ALL ".join(parts) + ")")


SCORED_BINARY_SQL = scored_binary_sql()


# --- scored rows from formulas: multiclass (label = return flag, prediction by discount band)
def scored_multiclass(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pred = (F.when(F.col("l_discount") < 0.04, "A").when(F.col("l_discount") < 0.07, "N")
            .otherwise("R"))
    return li.select(F.expr(LI_RID).alias("id"),
                     F.col("l_returnflag").alias("label"), pred.alias("prediction"),
                     F.lit("band").alias("model"))


SCORED_MULTICLASS_SQL = """
SELECT """ + LI_RID + """ AS id, l_returnflag AS label,
       CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS prediction,
       'band' AS model
FROM lineitem"""


# --- scored rows: regression (actual = extended price, predicted = quantity * mean unit price)
def scored_regression(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.expr(LI_RID).alias("id"),
                     F.col("l_extendedprice").alias("label"),
                     (F.col("l_quantity") * 1500.0).alias("prediction"),
                     F.pmod(F.col("l_orderkey"), F.lit(5)).cast("long").alias("fold"))


SCORED_REGRESSION_SQL = """
SELECT """ + LI_RID + """ AS id, l_extendedprice AS label,
       l_quantity * 1500.0 AS prediction, CAST(l_orderkey % 5 AS BIGINT) AS fold
FROM lineitem"""


# --- long per-class scores for one-vs-rest AUC: (id, label, class, score)
OVR_SCORES = [
    ("A", "1.0 - l_discount * 10"),
    ("N", "l_tax * 12.5"),
    ("R", "l_discount * 5 + l_tax * 6.25"),
]


def scored_ovr(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ident = F.expr(LI_RID).alias("id")
    structs = [F.struct(F.lit(c).alias("class"), F.expr(e).alias("score")) for c, e in OVR_SCORES]
    return (li.select(ident, F.col("l_returnflag").alias("label"), F.explode(F.array(*structs)).alias("s"))
              .select("id", "label", "s.class", "s.score"))


SCORED_OVR_SQL = " UNION ALL ".join(
    f"SELECT {LI_RID} AS id, l_returnflag AS label, '{c}' AS class, "
    f"{sql} AS score FROM lineitem" for c, sql in OVR_SCORES)


# --- lineitem for EDA: an imbalanced 0/1 target and two strongly correlated columns
def lineitem_eda(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_dirty(spark, d).select(
        "*", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("l_gross"),
        F.when(F.col("l_discount") >= 0.09, 1).otherwise(0).alias("big_disc"))


LINEITEM_EDA_SQL = f"""
SELECT *, l_extendedprice * (1 + l_tax) AS l_gross,
       CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS big_disc
FROM ({LINEITEM_DIRTY_SQL})"""

LINEITEM_EDA_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                        "l_extendedprice", "l_discount", "l_tax", "tiny_disc", "l_gross", "big_disc"]


# --- lineitem with a row id, a price column with planted outliers (2 % of rows x100)
def lineitem_outl(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem_dirty(spark, d)
    return li.select(
        F.expr(LI_RID).alias("rid"), "*",
        F.when(F.col("l_quantity") >= 50, F.col("l_extendedprice") * 100)
         .otherwise(F.col("l_extendedprice")).alias("l_price_outl"))


LINEITEM_OUTL_SQL = f"""
SELECT {LI_RID} AS rid, *,
       CASE WHEN l_quantity >= 50 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_price_outl
FROM ({LINEITEM_DIRTY_SQL})"""


def lineitem_clean_src(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem_outl(spark, d)
    return li.unionByName(li.where(F.col("l_linenumber") == 7))


LINEITEM_CLEAN_SRC_SQL = f"""
SELECT * FROM ({LINEITEM_OUTL_SQL}) UNION ALL SELECT * FROM ({LINEITEM_OUTL_SQL}) WHERE l_linenumber = 7"""

LINEITEM_OUTL_COLS = ["rid"] + [c for c, _, _ in LINEITEM_DIRTY_COLS] + ["l_price_outl"]
