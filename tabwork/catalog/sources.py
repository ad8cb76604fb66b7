"""Source/sink and column-detection queries (§2.1, §2.2).

File-format readers are checked by writing a whole driver table in that
format to a fresh folder under the session checkpoint dir and reading it back.
"""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import detect as DT
from ..session import table
from ..sources import io as IO
from .inputs import LINEITEM_DIRTY_SQL, lineitem_dirty, rounded


def q_read_csv_auto(spark, d):
    path = IO.scratch_path(spark, "csv-semicolon")
    table(spark, d, "customer").write.option("header", True).option("sep", ";").csv(path)
    df = IO.read_csv_auto(spark, path)
    return rounded(df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                             F.col("c_acctbal").cast("double"), "c_mktsegment"))


def q_read_csv_tab(spark, d):
    path = IO.scratch_path(spark, "csv-tab")
    table(spark, d, "part").write.option("header", True).option("sep", "\t").csv(path)
    df = IO.read_csv_auto(spark, path)
    return rounded(df.select(F.col("p_partkey").cast("long"), "p_name", "p_brand", "p_type",
                             F.col("p_size").cast("int"), F.col("p_retailprice").cast("double")))


def q_read_parquet(spark, d):
    return IO.read_table(spark, os.path.join(d, "nation.parquet"))


def q_read_json(spark, d):
    path = IO.scratch_path(spark, "json") + ".json"
    table(spark, d, "supplier").write.json(path)
    df = IO.read_table(spark, path)
    return rounded(df.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"),
                             F.col("s_acctbal").cast("double")))


def q_dispatch_by_extension(spark, d):
    path = IO.scratch_path(spark, "no_extension")
    table(spark, d, "region").write.option("header", True).option("sep", "|").csv(path)
    df = IO.read_table(spark, path)
    return df.select(F.col("r_regionkey").cast("int"), "r_name")


def q_write_versioned(spark, d):
    base = IO.scratch_path(spark, "datasets")
    m = IO.write_versioned(lineitem_dirty(spark, d).dropna(subset=["l_quantity"]), base, "lineitem", "cleaned")
    return m.select("dataset_id", "stage", "row_count", "col_count")


def q_numeric_columns(spark, d):
    return DT.numeric_columns_frame(lineitem_dirty(spark, d)).withColumn("position", F.col("position").cast("long"))


def q_detect_text_columns(spark, d):
    return rounded(DT.detect_text_columns(table(spark, d, "documents")))


def q_detect_date_column(spark, d):
    return rounded(DT.detect_date_column(lineitem_dirty(spark, d).drop("l_shipdate")))


QUERIES = {
    "read_csv_auto": q_read_csv_auto,
    "read_csv_tab": q_read_csv_tab,
    "read_parquet": q_read_parquet,
    "read_json": q_read_json,
    "dispatch_by_extension": q_dispatch_by_extension,
    "write_versioned": q_write_versioned,
    "numeric_columns": q_numeric_columns,
    "detect_text_columns": q_detect_text_columns,
    "detect_date_column": q_detect_date_column,
}

_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "tiny_disc"]
_DT = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
_POS = {"l_orderkey": 0, "l_partkey": 1, "l_suppkey": 2, "l_linenumber": 3, "l_quantity": 4, "l_extendedprice": 5,
        "l_discount": 6, "l_tax": 7, "tiny_disc": 13}

def _date_sql():
    from ..operators.profile import DATE_SHAPE
    from .inputs import LINEITEM_DIRTY_SQL
    parts = []
    for i, c in enumerate(["l_returnflag", "l_linestatus", "first_flag", "ship_str"]):
        ts = f"CASE WHEN regexp_matches(trim({c}), '{DATE_SHAPE}') THEN try_cast(trim({c}) AS TIMESTAMP) END"
        parts.append(f"SELECT {i} AS pos, '{c}' AS column_name, count({ts}) / count({c}) AS s FROM ({LINEITEM_DIRTY_SQL})")
    return ("SELECT column_name, round(s, 5) AS parse_share FROM (" + " UNION ALL ".join(parts) +
            ") WHERE s > 0.7 ORDER BY pos LIMIT 1")


ORACLE = {
    "read_csv_auto": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 5) AS c_acctbal, c_mktsegment FROM customer",
    "read_csv_tab": "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 5) AS p_retailprice FROM part",
    "read_parquet": "SELECT * FROM nation",
    "read_json": "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 5) AS s_acctbal FROM supplier",
    "dispatch_by_extension": "SELECT r_regionkey, r_name FROM region",
    "write_versioned": """SELECT 'lineitem' AS dataset_id, 'cleaned' AS stage, count(*) AS row_count, CAST(14 AS BIGINT) AS col_count
FROM lineitem WHERE l_linenumber <> 3""",
    "numeric_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({_POS[c]} AS BIGINT) AS position, '{_DT.get(c, 'double')}' AS dtype, "
        f"count({c}) AS n_non_null FROM ({LINEITEM_DIRTY_SQL})"
        for c in _NUMS),
    "detect_text_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(len(string_split_regex(trim({c}), '\\s+'))), 5) AS avg_words, "
        f"coalesce(avg(len(string_split_regex(trim({c}), '\\s+'))) >= 3.0, FALSE) AS is_text FROM documents"
        for c in ("text", "lang", "source")),
    "detect_date_column": _date_sql(),
}
