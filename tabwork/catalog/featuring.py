"""Feature engineering and selection queries (§2.9, select_features of §2.2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import profile as P
from ..operators import selection as SE
from ..plans import features as FP
from ..session import table
from .balance import DAILY_SQL, daily_orders
from .inputs import LINEITEM_EDA_SQL, LINEITEM_OUTL_SQL, lineitem_eda, lineitem_outl, rounded

OUTL = f"({LINEITEM_OUTL_SQL})"
EDA = f"({LINEITEM_EDA_SQL})"


def _r(x):
    return f"round({x}, 5)"


# ------------------------------------------------------------------ plan
def q_feature_plan(spark, d):
    df = lineitem_outl(spark, d)
    return FP.feature_plan(P.profile_columns(df), target="l_returnflag")


def _plan_sql():
    from .cleaning import _profile_sql
    # the cleaning source adds duplicates; recompute the same facts on lineitem_outl
    prof = _profile_sql().replace("FROM (\nSELECT * FROM (", "FROM (\nSELECT * FROM (")
    from .inputs import LINEITEM_CLEAN_SRC_SQL
    prof = prof.replace(f"({LINEITEM_CLEAN_SRC_SQL})", OUTL)
    dtypes = {"rid": "bigint", "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
              "l_linenumber": "int", "l_shipdate": "timestamp_ntz"}
    dt = "CASE column_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dtypes.items()) + \
        " WHEN 'l_returnflag' THEN 'string' WHEN 'l_linestatus' THEN 'string' WHEN 'first_flag' THEN 'string' " \
        "WHEN 'ship_str' THEN 'string' ELSE 'double' END"
    return f"""
WITH p AS (SELECT *, {dt} AS dtype, uc / n_rows AS ratio FROM ({prof}) WHERE column_name <> 'l_returnflag'),
s AS (SELECT *, inferred_type IN ('categorical', 'text') AND ratio > 0.9 AS id_like,
             inferred_type = 'numeric' AND sk IS NOT NULL AND abs(sk) > 2.0 AS lg FROM p)
SELECT 'feature:' || column_name AS spec_id, CAST(position AS BIGINT) AS position, column_name AS source_column,
  CASE WHEN id_like THEN column_name WHEN lg THEN column_name || '_log' WHEN inferred_type = 'datetime'
       THEN column_name || '_parts' ELSE column_name END AS output_name,
  CASE WHEN id_like THEN 'none' WHEN lg THEN 'log' WHEN inferred_type = 'numeric' THEN 'standard_scale'
       WHEN inferred_type = 'categorical' AND uc <= 15 THEN 'one_hot_encode' WHEN inferred_type = 'categorical'
       THEN 'label_encode' WHEN inferred_type = 'datetime' THEN 'date_parts' END AS transform,
  dtype AS dtype_in, CASE WHEN id_like THEN dtype WHEN inferred_type = 'numeric' THEN 'float64' ELSE 'int64' END AS dtype_out,
  NOT id_like AS enabled,
  CASE WHEN id_like THEN 'High cardinality — likely an ID column. Disabled by default.'
       WHEN lg THEN printf('Skewness=%.2f → log transform recommended', sk)
       WHEN inferred_type = 'numeric' THEN 'Numeric — standard scaling'
       WHEN inferred_type = 'categorical' AND uc <= 15 THEN printf('Low cardinality (%d) → one-hot encode', uc)
       WHEN inferred_type = 'categorical' AND uc <= 50 THEN printf('Medium cardinality (%d) → label encode', uc)
       WHEN inferred_type = 'categorical' THEN printf('High cardinality (%d) → label encode (consider target encode)', uc)
       WHEN inferred_type = 'datetime' THEN 'Datetime → extract year/month/day/dayofweek' END AS note
FROM s"""


# ------------------------------------------------------------------ apply
APPLY_SPECS = [
    {"source_column": "rid", "output_name": "rid", "transform": "none"},
    {"source_column": "l_price_outl", "output_name": "l_price_outl_log", "transform": "log"},
    {"source_column": "l_tax", "output_name": "l_tax_sqrt", "transform": "sqrt"},
    {"source_column": "l_quantity", "output_name": "l_quantity", "transform": "standard_scale"},
    {"source_column": "l_discount", "output_name": "l_discount", "transform": "min_max_scale"},
    {"source_column": "l_linestatus", "output_name": "ls", "transform": "one_hot_encode"},
    {"source_column": "first_flag", "output_name": "first_flag", "transform": "label_encode"},
    {"source_column": "ship_str", "output_name": "ship", "transform": "date_parts"},
    {"source_column": "l_extendedprice", "output_name": "price_off", "transform": "log", "enabled": False},
]


def q_feature_apply(spark, d):
    return rounded(FE.feature_apply(lineitem_outl(spark, d), APPLY_SPECS, target="l_returnflag"))


LOG_E = "ln(1 + coalesce(l_price_outl, 0) + CASE WHEN mn_p <= 0 THEN abs(mn_p) + 1 ELSE 0 END)"
SQRT_E = "sqrt(coalesce(l_tax, 0) + CASE WHEN mn_t < 0 THEN abs(mn_t) ELSE 0 END)"
STD_E = "CASE WHEN sd_q > 0 THEN (coalesce(l_quantity, m_q) - m_q) / sd_q ELSE coalesce(l_quantity, 0) END"
MM_E = ("CASE WHEN mx_d > mn_d THEN (coalesce(l_discount, mn_d) - mn_d) / (mx_d - mn_d) "
        "ELSE coalesce(l_discount, 0) END")
STATS_SQL = (f"(SELECT min(l_price_outl) AS mn_p, min(l_tax) AS mn_t, avg(l_quantity) AS m_q, "
             f"stddev_samp(l_quantity) AS sd_q, min(l_discount) AS mn_d, max(l_discount) AS mx_d FROM {OUTL}) s")
CODES_SQL = (f"(SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
             f"(SELECT DISTINCT coalesce(first_flag, 'missing') AS v FROM {OUTL})) c")


def _date_parts_sql(c, out):
    ts = f"try_cast({c} AS TIMESTAMP)"
    return (f"CAST(coalesce(year({ts}), 0) AS INT) AS {out}_year, CAST(coalesce(month({ts}), 0) AS INT) AS {out}_month, "
            f"CAST(coalesce(day({ts}), 0) AS INT) AS {out}_day, CAST(coalesce(isodow({ts}) - 1, 0) AS INT) AS {out}_dow")


APPLY_SQL = f"""
SELECT rid, {_r(LOG_E)} AS l_price_outl_log, {_r(SQRT_E)} AS l_tax_sqrt, {_r(STD_E)} AS l_quantity,
  {_r(MM_E)} AS l_discount, CAST(l_linestatus = 'F' AS INT) AS ls_F, CAST(l_linestatus = 'O' AS INT) AS ls_O,
  c.code AS first_flag, {_date_parts_sql('ship_str', 'ship')}, l_returnflag
FROM {OUTL} t LEFT JOIN {CODES_SQL} ON coalesce(t.first_flag, 'missing') = c.v, {STATS_SQL}"""


def _single(spec, out_cols):
    def q(spark, d):
        out = FE.feature_apply(lineitem_outl(spark, d), [APPLY_SPECS[0], spec])
        return rounded(out.select("rid", *out_cols))
    return q


def _single_sql(select, joins=""):
    return f"SELECT rid, {select} FROM {OUTL} t {joins}, {STATS_SQL}"


def q_fe_label_encode(spark, d):
    part = table(spark, d, "part")
    out = FE.fe_label_encode(part, ["p_brand", "p_type"])
    return out.select("p_partkey", F.col("p_brand").alias("brand_code"), F.col("p_type").alias("type_code"))


LABEL_SQL = """
WITH b AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT p_brand AS v FROM part)),
t AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT p_type AS v FROM part))
SELECT p_partkey, b.code AS brand_code, t.code AS type_code FROM part JOIN b ON p_brand = b.v JOIN t ON p_type = t.v"""


def q_fe_target_encode(spark, d):
    df = lineitem_eda(spark, d).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "big_disc",
        F.concat("l_returnflag", "l_linestatus").alias("cat"),
        F.pmod("l_orderkey", F.lit(5)).alias("fold"))
    out = FE.fe_target_encode(df, "cat", "big_disc", "fold")
    from .inputs import LI_RID
    return rounded(out.select(F.expr(LI_RID).alias("rid"), "cat_te"))


def _te_sql():
    from .inputs import LI_RID
    return f"""
WITH t AS (SELECT {LI_RID} AS rid, l_returnflag || l_linestatus AS cat, l_orderkey % 5 AS fold,
                  CAST(big_disc AS DOUBLE) AS y FROM {EDA}),
cf AS (SELECT cat, fold, sum(y) AS sy, count(y) AS n FROM t GROUP BY ALL),
c AS (SELECT cat, sum(sy) AS syc, sum(n) AS nc FROM cf GROUP BY cat),
f AS (SELECT fold, sum(sy) AS syf, sum(n) AS nf FROM cf GROUP BY fold),
a AS (SELECT sum(sy) AS sya, sum(n) AS na FROM cf),
e AS (SELECT cf.cat, cf.fold, ((syc - sy) + 10.0 * ((sya - syf) / (na - nf))) / ((nc - n) + 10.0) AS te
      FROM cf JOIN c ON cf.cat = c.cat JOIN f ON cf.fold = f.fold, a)
SELECT rid, round(te, 5) AS cat_te FROM t JOIN e ON t.cat = e.cat AND t.fold = e.fold"""


def q_fe_bin(spark, d):
    df = lineitem_outl(spark, d)
    r = df.agg(F.min("l_extendedprice").alias("mn"), F.max("l_extendedprice").alias("mx")).first()
    edges = FE.equal_width_edges(r["mn"], r["mx"], 10)
    return df.select("rid", FE.fe_bin(F.col("l_extendedprice"), edges).cast("long").alias("price_bin"))


BIN_SQL = f"""
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM {OUTL})
SELECT rid, CAST(len(list_filter([mn + (mx - mn) * 1 / 10, mn + (mx - mn) * 2 / 10, mn + (mx - mn) * 3 / 10,
  mn + (mx - mn) * 4 / 10, mn + (mx - mn) * 5 / 10, mn + (mx - mn) * 6 / 10, mn + (mx - mn) * 7 / 10,
  mn + (mx - mn) * 8 / 10, mn + (mx - mn) * 9 / 10], lambda e: e < l_extendedprice)) AS BIGINT) AS price_bin
FROM {OUTL}, s"""


def q_fe_bin_quantile(spark, d):
    df = lineitem_outl(spark, d)
    edges = df.agg(F.percentile(F.col("l_extendedprice"), F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e")).first()["e"]
    return df.select("rid", FE.fe_bin(F.col("l_extendedprice"), edges).cast("long").alias("price_qbin"))


QBIN_SQL = f"""
WITH s AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM {OUTL})
SELECT rid, CAST(len(list_filter(e, lambda x: x < l_extendedprice)) AS BIGINT) AS price_qbin FROM {OUTL}, s"""


def q_fe_polynomial(spark, d):
    return rounded(lineitem_outl(spark, d).select("rid", *FE.fe_polynomial(["l_quantity", "l_discount"], 2)))


POLY_SQL = f"""SELECT rid, round(pow(l_quantity, 2), 5) AS l_quantity_pow2, round(pow(l_discount, 2), 5) AS l_discount_pow2,
round(l_quantity * l_discount, 5) AS l_quantity_x_l_discount FROM {OUTL}"""


def q_fe_interaction(spark, d):
    return rounded(lineitem_outl(spark, d).select("rid", FE.fe_interaction("l_quantity", "l_tax")))


INTER_SQL = f"SELECT rid, round(l_quantity * l_tax, 5) AS l_quantity_x_l_tax FROM {OUTL}"


# ------------------------------------------------------------------ text
def q_fe_tfidf(spark, d):
    return rounded(FE.tfidf(table(spark, d, "documents"), "text", "doc_id"))


TFIDF_BASE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
terms AS (SELECT doc_id, unnest(t || CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                         ELSE []::VARCHAR[] END) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2),
v AS (SELECT * FROM st ORDER BY cf DESC, term LIMIT 10000),
n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN v ON tf.term = v.term, n),
nm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id),
w AS (SELECT raw.doc_id, term, raw / norm AS weight FROM raw JOIN nm ON raw.doc_id = nm.doc_id)"""

TFIDF_SQL = TFIDF_BASE + " SELECT doc_id, term, round(weight, 5) AS weight FROM w"


def q_tfidf_top_terms(spark, d):
    docs = table(spark, d, "documents")
    w = FE.tfidf(docs, "text", "doc_id")
    return rounded(FE.tfidf_top_terms(w, docs.agg(F.count(F.lit(1)).alias("n_docs"))))


TOP_TERMS_SQL = TFIDF_BASE + """
SELECT term, round(sum(weight) / (SELECT n FROM n), 5) AS score FROM w GROUP BY term
ORDER BY sum(weight) / (SELECT n FROM n) DESC, term LIMIT 20"""


def q_fe_lags(spark, d):
    s = daily_orders(spark, d)
    out = FE.fe_lags(s, "y", "day", lags=3, series=["series"])
    return out.select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), "y", "lag_1", "lag_2", "lag_3")


def q_fe_lags_skew_safe(spark, d):
    s = daily_orders(spark, d)
    out = FE.fe_lags(s, "y", "day", lags=3, series=["series"], method="join")
    return out.select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), "y", "lag_1", "lag_2", "lag_3")


LAGS_SQL = f"""
SELECT * FROM (SELECT series, strftime(day, '%Y-%m-%d') AS day, y,
  lag(y, 1) OVER (PARTITION BY series ORDER BY day) AS lag_1, lag(y, 2) OVER (PARTITION BY series ORDER BY day) AS lag_2,
  lag(y, 3) OVER (PARTITION BY series ORDER BY day) AS lag_3 FROM {DAILY_SQL}) WHERE lag_3 IS NOT NULL"""


# ------------------------------------------------------------------ matrix and selection
MATRIX_FEATURES = ["rid", "l_quantity", "l_discount", "l_tax", "first_flag", "l_linestatus"]


def q_prep_matrix(spark, d):
    return rounded(FE.prep_matrix(lineitem_outl(spark, d), MATRIX_FEATURES, "l_returnflag"))


def _matrix_sql(scale: bool):
    codes = []
    for c in ("first_flag", "l_linestatus"):
        codes.append(f"{c[:2]} AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
                     f"(SELECT DISTINCT coalesce({c}, '__missing__') AS v FROM {OUTL}))")
    base = f"""
WITH {", ".join(codes)},
m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt,
             quantile_cont(rid, 0.5) AS mr FROM {OUTL}),
x AS (SELECT CAST(coalesce(rid, mr) AS DOUBLE) AS rid, coalesce(l_quantity, mq) AS l_quantity, coalesce(l_discount, md) AS l_discount,
             coalesce(l_tax, mt) AS l_tax, CAST(fi.code AS DOUBLE) AS first_flag, CAST(l_.code AS DOUBLE) AS l_linestatus,
             l_returnflag
      FROM {OUTL} t JOIN fi ON coalesce(t.first_flag, '__missing__') = fi.v
      JOIN l_ ON coalesce(t.l_linestatus, '__missing__') = l_.v, m)"""
    if not scale:
        return base + " SELECT " + ", ".join(_r(c) + f" AS {c}" for c in MATRIX_FEATURES) + ", l_returnflag FROM x"
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in MATRIX_FEATURES)
    sel = ", ".join(_r(f"({c} - a_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END") + f" AS {c}" for c in MATRIX_FEATURES)
    return base + f", s AS (SELECT {stats} FROM x) SELECT {sel}, l_returnflag FROM x, s"


def q_prep_scaled_matrix(spark, d):
    return rounded(FE.prep_matrix(lineitem_outl(spark, d), MATRIX_FEATURES, "l_returnflag", scale=True))


SEL_FEATURES = ["l_quantity", "l_discount", "l_tax", "first_flag", "l_linestatus", "l_extendedprice"]


def _encoded(spark, d):
    return FE.prep_matrix(lineitem_outl(spark, d), SEL_FEATURES, "l_returnflag")


def q_select_mutual_info(spark, d):
    return rounded(SE.select_mutual_info(_encoded(spark, d), SEL_FEATURES, "l_returnflag"))


def _encoded_sql():
    codes = []
    for c in ("first_flag", "l_linestatus"):
        codes.append(f"{c[:2]} AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
                     f"(SELECT DISTINCT coalesce({c}, '__missing__') AS v FROM {OUTL}))")
    return f"""(WITH {", ".join(codes)},
m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt,
             quantile_cont(l_extendedprice, 0.5) AS me FROM {OUTL})
SELECT coalesce(l_quantity, mq) AS l_quantity, coalesce(l_discount, md) AS l_discount, coalesce(l_tax, mt) AS l_tax,
  CAST(fi.code AS DOUBLE) AS first_flag, CAST(l_.code AS DOUBLE) AS l_linestatus,
  coalesce(l_extendedprice, me) AS l_extendedprice, l_returnflag
FROM {OUTL} t JOIN fi ON coalesce(t.first_flag, '__missing__') = fi.v
JOIN l_ ON coalesce(t.l_linestatus, '__missing__') = l_.v, m)"""


def _sel_mi_sql():
    from .exploration import _mi_sql
    mi = _mi_sql(SEL_FEATURES, "l_returnflag", _encoded_sql(), top=1000, rnd=False)
    return f"""
WITH s AS ({mi}), mx AS (SELECT max(mi) AS mx FROM s),
i AS (SELECT feature, mi / CASE WHEN mx > 0 THEN mx ELSE 1.0 END AS importance FROM s, mx)
SELECT feature, round(importance, 5) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
  'mutual_info' AS method, importance >= 0.01 AS keep FROM i"""


def q_select_pearson_abs(spark, d):
    feats = ["l_quantity", "l_discount", "l_tax", "tiny_disc", "l_gross"]
    return rounded(SE.select_pearson_abs(lineitem_eda(spark, d), feats, "big_disc"))


def _pearson_sql():
    feats = ["l_quantity", "l_discount", "l_tax", "tiny_disc", "l_gross"]
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, abs(coalesce(corr(CAST({f} AS DOUBLE), CAST(big_disc AS DOUBLE)), 0.0)) AS score FROM {EDA}"
        for f in feats)
    return f"""
WITH s AS ({parts}), mx AS (SELECT max(score) AS mx FROM s),
i AS (SELECT feature, score / CASE WHEN mx > 0 THEN mx ELSE 1.0 END AS importance FROM s, mx)
SELECT feature, round(importance, 5) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
  'pearson_abs' AS method, importance >= 0.01 AS keep FROM i"""


OVERRIDES = [("l_tax", "include"), ("l_discount", "exclude")]


def q_select_with_overrides(spark, d):
    imp = SE.select_mutual_info(_encoded(spark, d), SEL_FEATURES, "l_returnflag")
    ov = spark.createDataFrame(OVERRIDES, "feature string, override string")
    return rounded(SE.select_with_overrides(imp, ov))


def _overrides_sql():
    vals = ", ".join(f"('{a}', '{b}')" for a, b in OVERRIDES)
    return f"""
WITH i AS ({_sel_mi_sql()}), o AS (SELECT * FROM (VALUES {vals}) v(feature, override))
SELECT i.feature, importance, rank, method,
  CASE WHEN override = 'include' THEN TRUE WHEN override = 'exclude' THEN FALSE ELSE keep END AS keep,
  CASE WHEN override = 'include' THEN 'pinned' WHEN override = 'exclude' THEN 'excluded' ELSE 'auto' END AS decision
FROM i LEFT JOIN o ON i.feature = o.feature"""


def q_select_audit(spark, d):
    return SE.select_audit(q_select_with_overrides(spark, d))


def q_select_features(spark, d):
    enc = _encoded(spark, d)
    imp = SE.select_with_overrides(SE.select_mutual_info(enc, SEL_FEATURES, "l_returnflag"),
                                   spark.createDataFrame(OVERRIDES, "feature string, override string"))
    chosen = SE.select_features(enc, imp, "l_returnflag")
    # which columns are kept depends on the data, so the check compares them in long form
    return rounded(chosen.unpivot([], chosen.columns, "feature", "value"))


def _select_features_sql():
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM e" for f in SEL_FEATURES)
    return f"""
WITH e AS {_encoded_sql()}, d AS ({_overrides_sql()}), x AS ({long})
SELECT feature, round(value, 5) AS value FROM x WHERE feature IN (SELECT feature FROM d WHERE keep)"""


def q_leakage_scan(spark, d):
    feats = ["tiny_disc", "l_tax", "l_quantity", "big_disc"]
    return rounded(SE.leakage_scan(lineitem_eda(spark, d), feats, "l_discount"))


LEAK_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{f}' AS feature, round(abs(corr(CAST({f} AS DOUBLE), l_discount)), 5) AS correlation "
    f"FROM {EDA}) WHERE correlation > 0.85" for f in ["tiny_disc", "l_tax", "l_quantity", "big_disc"])


QUERIES = {
    "feature_plan": q_feature_plan,
    "feature_apply": q_feature_apply,
    "fe_log": _single(APPLY_SPECS[1], ["l_price_outl_log"]),
    "fe_sqrt": _single(APPLY_SPECS[2], ["l_tax_sqrt"]),
    "fe_standard_scale": _single(APPLY_SPECS[3], ["l_quantity"]),
    "fe_min_max_scale": _single(APPLY_SPECS[4], ["l_discount"]),
    "fe_one_hot": _single(APPLY_SPECS[5], ["ls_F", "ls_O"]),
    "fe_date_parts": _single(APPLY_SPECS[7], ["ship_year", "ship_month", "ship_day", "ship_dow"]),
    "fe_passthrough": _single({"source_column": "l_linestatus", "output_name": "status", "transform": "none"},
                              ["status"]),
    "fe_label_encode": q_fe_label_encode,
    "fe_target_encode": q_fe_target_encode,
    "fe_bin": q_fe_bin,
    "fe_bin_quantile": q_fe_bin_quantile,
    "fe_polynomial": q_fe_polynomial,
    "fe_interaction": q_fe_interaction,
    "fe_tfidf": q_fe_tfidf,
    "tfidf_top_terms": q_tfidf_top_terms,
    "fe_lags": q_fe_lags,
    "fe_lags_skew_safe": q_fe_lags_skew_safe,
    "prep_matrix": q_prep_matrix,
    "prep_scaled_matrix": q_prep_scaled_matrix,
    "select_mutual_info": q_select_mutual_info,
    "select_pearson_abs": q_select_pearson_abs,
    "select_with_overrides": q_select_with_overrides,
    "select_audit": q_select_audit,
    "select_features": q_select_features,
    "leakage_scan": q_leakage_scan,
}

ORACLE = {
    "feature_plan": _plan_sql(),
    "feature_apply": APPLY_SQL,
    "fe_log": _single_sql(f"{_r(LOG_E)} AS l_price_outl_log"),
    "fe_sqrt": _single_sql(f"{_r(SQRT_E)} AS l_tax_sqrt"),
    "fe_standard_scale": _single_sql(f"{_r(STD_E)} AS l_quantity"),
    "fe_min_max_scale": _single_sql(f"{_r(MM_E)} AS l_discount"),
    "fe_one_hot": _single_sql("CAST(l_linestatus = 'F' AS INT) AS ls_F, CAST(l_linestatus = 'O' AS INT) AS ls_O"),
    "fe_date_parts": _single_sql(_date_parts_sql("ship_str", "ship")),
    "fe_passthrough": f"SELECT rid, l_linestatus AS status FROM {OUTL}",
    "fe_label_encode": LABEL_SQL,
    "fe_target_encode": _te_sql(),
    "fe_bin": BIN_SQL,
    "fe_bin_quantile": QBIN_SQL,
    "fe_polynomial": POLY_SQL,
    "fe_interaction": INTER_SQL,
    "fe_tfidf": TFIDF_SQL,
    "tfidf_top_terms": TOP_TERMS_SQL,
    "fe_lags": LAGS_SQL,
    "fe_lags_skew_safe": LAGS_SQL,
    "prep_matrix": _matrix_sql(False),
    "prep_scaled_matrix": _matrix_sql(True),
    "select_mutual_info": _sel_mi_sql(),
    "select_pearson_abs": _pearson_sql(),
    "select_with_overrides": _overrides_sql(),
    "select_features": _select_features_sql(),
    "select_audit": f"""SELECT CAST(sum(CAST(keep AS BIGINT)) AS BIGINT) AS kept, CAST(sum(CAST(NOT keep AS BIGINT)) AS BIGINT) AS dropped,
  CAST(sum(CAST(decision = 'pinned' AS BIGINT)) AS BIGINT) AS pinned, CAST(sum(CAST(decision = 'excluded' AS BIGINT)) AS BIGINT) AS excluded,
  CAST(sum(CAST(decision = 'auto' AS BIGINT)) AS BIGINT) AS auto FROM ({_overrides_sql()})""",
    "leakage_scan": LEAK_SQL,
}
