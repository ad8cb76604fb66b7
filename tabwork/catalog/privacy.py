"""PII queries (§2.3): table scans over a contacts table derived from
``customer`` and free-text redaction over whole ``documents``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..operators import pii as P
from ..session import table
from .inputs import rounded

# (column, expression valid in Spark SQL and DuckDB) — formatted from real keys
CONTACT_COLS = [
    ("c_custkey", "c_custkey"),
    ("c_name", "c_name"),
    ("email", "'user' || CAST(c_custkey AS STRING) || '@example.com'"),
    ("phone", "'(212) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"),
    ("ref_code", "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || "
                 "lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"),
    ("ip", "'10.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 256 AS STRING) || '.' || "
           "CAST(c_custkey % 200 + 1 AS STRING)"),
    ("card", "CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '5500 0000 0000 0004' END"),
    ("account", "'DE89ABCD' || lpad(CAST(c_custkey AS STRING), 10, '0')"),
    ("birth_date", "CAST(c_custkey AS STRING)"),
    ("home_city", "'City ' || CAST(c_nationkey AS STRING)"),
    ("c_acctbal", "c_acctbal"),
    ("c_mktsegment", "c_mktsegment"),
    ("note", "CASE WHEN c_custkey % 25 = 0 THEN 'call 212-555-0100' ELSE 'none' END"),
]
CONTACTS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONTACT_COLS) + " FROM customer"
STRING_COLS = [c for c, _ in CONTACT_COLS if c not in ("c_custkey", "c_acctbal")]
ALL_COLS = [c for c, _ in CONTACT_COLS]


def contacts(spark, d):
    return table(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in CONTACT_COLS])


def _luhn_sql(s: str) -> str:
    return ("(list_sum(list_transform(list_reverse(string_split(" + s + ", '')), lambda d, i: "
            "CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(d AS INT) * 2 > 9 THEN CAST(d AS INT) * 2 - 9 "
            "ELSE CAST(d AS INT) * 2 END) ELSE CAST(d AS INT) END)) % 10 = 0)")


DIGITS_ONLY_SQL = "regexp_replace(x, '[^0-9]', '', 'g')"


def _cards_sql(v: str) -> str:
    return (f"list_filter(regexp_extract_all({v}, '{PT.CREDIT_CARD}'), "
            f"lambda x: {_luhn_sql(DIGITS_ONLY_SQL)})")


def _hit_sql(entity: str, v: str) -> str:
    if entity == "CREDIT_CARD":
        return f"len({_cards_sql(v)}) > 0"
    return f"regexp_matches({v}, '{PT.CONTENT_PATTERNS[entity]}')"


def _hits_sql(strict: bool) -> str:
    parts = []
    for pos, c in enumerate(ALL_COLS):
        scan = strict or c in STRING_COLS
        ne = P.name_entity(c, strict)
        cols = [f"'{c}' AS column_name", f"CAST({pos} AS BIGINT) AS position",
                (f"'{ne}'" if ne else "NULL::VARCHAR") + " AS name_entity", f"count({c}) AS non_null"]
        for e in PT.CONTENT_PATTERNS:
            v = f"CAST({c} AS VARCHAR)"
            cols.append((f"CAST(coalesce(sum(CASE WHEN {_hit_sql(e, v)} THEN 1 ELSE 0 END), 0) AS BIGINT)"
                         if scan else "CAST(0 AS BIGINT)") + f" AS {e.lower()}_count")
        parts.append("SELECT " + ", ".join(cols) + f" FROM ({CONTACTS_SQL})")
    return " UNION ALL ".join(parts)


def _scan_sql(strict: bool) -> str:
    order = PT.STRICT_ORDER if strict else PT.DEFAULT_ORDER
    ent = "CASE WHEN name_entity IS NOT NULL AND non_null > 0 THEN name_entity " + " ".join(
        f"WHEN non_null > 0 AND {e.lower()}_count / non_null >= 0.05 THEN '{e}'" for e in order) + " END"
    cnt = "CASE WHEN name_entity IS NOT NULL AND non_null > 0 THEN non_null " + " ".join(
        f"WHEN non_null > 0 AND {e.lower()}_count / non_null >= 0.05 THEN {e.lower()}_count" for e in order) + " END"
    sens = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PT.SENSITIVITY.items()) + " END"
    act = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PT.ACTION.items()) + " END"
    return f"""
WITH h AS ({_hits_sql(strict)}),
s AS (SELECT column_name, position, {ent} AS entity_type, {cnt} AS match_count, name_entity, non_null FROM h)
SELECT column_name, position, entity_type, {sens} AS sensitivity, CAST(match_count AS BIGINT) AS match_count,
  CASE WHEN name_entity IS NOT NULL THEN 1.0 ELSE round(round(match_count / non_null, 4), 5) END AS match_pct,
  {act} AS recommended_action, 'pending' AS status
FROM s WHERE entity_type IS NOT NULL"""


def q_pii_scan_table(spark, d):
    return rounded(P.pii_scan_table(contacts(spark, d)))


def q_pii_scan_strict(spark, d):
    return rounded(P.pii_scan_table(contacts(spark, d), strict=True))


def q_pii_scan_by_name(spark, d):
    h = P.pii_hits(contacts(spark, d))
    return h.where(F.col("name_entity").isNotNull()).select(
        "column_name", F.col("name_entity").alias("entity_type"), F.col("non_null").alias("match_count"))


BY_NAME_SQL = f"SELECT column_name, name_entity AS entity_type, non_null AS match_count FROM ({_hits_sql(False)}) WHERE name_entity IS NOT NULL"


def _entity_query(entity):
    def q(spark, d):
        h = P.pii_hits(contacts(spark, d)).where(F.col("column_name").isin(STRING_COLS))
        c = F.col(entity.lower() + "_count")
        pct = F.when(F.col("non_null") > 0, c / F.col("non_null")).otherwise(F.lit(0.0))
        return rounded(h.select("column_name", c.alias("match_count"), pct.alias("match_pct"),
                                (pct >= 0.05).alias("flagged")))
    return q


def _entity_sql(entity):
    c = f"{entity.lower()}_count"
    return f"""SELECT column_name, {c} AS match_count,
  round(CASE WHEN non_null > 0 THEN {c} / non_null ELSE 0.0 END, 5) AS match_pct,
  CASE WHEN non_null > 0 THEN {c} / non_null ELSE 0.0 END >= 0.05 AS flagged
FROM ({_hits_sql(False)}) WHERE column_name IN ({", ".join(repr(s) for s in STRING_COLS)})"""


def q_pii_risk_score(spark, d):
    df = contacts(spark, d)
    return P.pii_risk_score(P.pii_scan_table(df), len(df.columns))


RISK_SQL = f"""
SELECT CAST({len(ALL_COLS)} AS BIGINT) AS total_columns, CAST(count(*) AS BIGINT) AS n_findings,
  CAST(least(100, round_even(CAST(coalesce(sum(CASE sensitivity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), 0) AS DOUBLE)
    / {float(3 * len(ALL_COLS))!r} * 100, 0)) AS BIGINT) AS risk_score
FROM ({_scan_sql(False)})"""


def q_pii_sample_mask(spark, d):
    df = contacts(spark, d)
    s = P.pii_samples(df, P.pii_scan_table(df), k=3)
    return s.select("column_name", F.col("rank").cast("long").alias("rank"), "sample")


def _mask_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN length({v}) <= 4 THEN '***' "
            f"ELSE substr({v}, 1, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END")


def _samples_sql() -> str:
    # flagged columns of the default scan and their entities, resolved from the oracle scan itself
    parts = []
    for c in ALL_COLS:
        v = f"CAST({c} AS VARCHAR)"
        ne = P.name_entity(c, False)
        hit = "TRUE" if ne else " OR ".join(
            f"(f.entity_type = '{e}' AND {_hit_sql(e, v)})" for e in PT.CONTENT_PATTERNS)
        parts.append(f"SELECT DISTINCT '{c}' AS column_name, {v} AS value FROM ({CONTACTS_SQL}) t "
                     f"JOIN f ON f.column_name = '{c}' WHERE {v} IS NOT NULL AND ({hit})")
    return f"""
WITH f AS ({_scan_sql(False)}),
v AS ({" UNION ALL ".join(parts)}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rank FROM v)
SELECT column_name, CAST(rank AS BIGINT) AS rank, {_mask_sql('value')} AS sample FROM r WHERE rank <= 3"""


# ------------------------------------------------------------------ apply actions
def q_pii_apply_mask(spark, d):
    return P.pii_apply_mask(contacts(spark, d), ["email", "phone", "ip"]).select(
        "c_custkey", "email", "phone", "ip")


MASK_APPLY_SQL = f"SELECT c_custkey, {_mask_sql('email')} AS email, {_mask_sql('phone')} AS phone, {_mask_sql('ip')} AS ip FROM ({CONTACTS_SQL})"


def q_pii_apply_hash(spark, d):
    return P.pii_apply_hash(contacts(spark, d), ["ref_code"], salt="s1").select("c_custkey", "ref_code")


HASH_APPLY_SQL = f"SELECT c_custkey, sha256('s1' || ref_code) AS ref_code FROM ({CONTACTS_SQL})"


def q_pii_apply_pseudonymize(spark, d):
    return P.pii_apply_pseudonymize(contacts(spark, d), ["c_name"], key="k1").select("c_custkey", "c_name")


PSEUDO_SQL = f"SELECT c_custkey, 'C_NA_' || substr(sha256('k1' || c_name), 1, 32) AS c_name FROM ({CONTACTS_SQL})"


def q_pii_apply_drop(spark, d):
    return rounded(P.pii_apply_drop(contacts(spark, d), ["email", "phone", "card"]))


DROP_SQL = ("SELECT " + ", ".join(c if c != "c_acctbal" else "round(c_acctbal, 5) AS c_acctbal"
                                   for c in ALL_COLS if c not in ("email", "phone", "card"))
            + f" FROM ({CONTACTS_SQL})")


def q_pii_apply_approve(spark, d):
    return rounded(P.pii_apply_approve(contacts(spark, d), ["c_name"]))


APPROVE_SQL = ("SELECT " + ", ".join(c if c != "c_acctbal" else "round(c_acctbal, 5) AS c_acctbal"
                                      for c in ALL_COLS) + f" FROM ({CONTACTS_SQL})")


def q_pii_apply_encrypt(spark, d):
    """Round trip: every encrypted value decrypts back to the original."""
    df = contacts(spark, d).select("c_custkey", F.col("card").alias("orig"), "card")
    enc = P.pii_apply_encrypt(df, ["card"], key="0123456789abcdef")
    dec = P.pii_decrypt(enc, ["card"], key="0123456789abcdef")
    return dec.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sum((F.col("card") == F.col("orig")).cast("long")).alias("n_roundtrip"))


ENCRYPT_SQL = "SELECT count(*) AS n_rows, CAST(count(*) AS BIGINT) AS n_roundtrip FROM customer"


# ------------------------------------------------------------------ free text
def q_pii_text_redact(spark, d):
    docs = table(spark, d, "documents")
    r = P.pii_text_redact(docs, "text", keep=["doc_id"])
    return r.withColumn("redacted", F.sha2("redacted", 256))


def _redact_sql(src: str, id_col: str, text: str) -> str:
    counts = []
    for e, rx in PT.CONTENT_PATTERNS.items():
        found = _cards_sql(text) if e == "CREDIT_CARD" else f"regexp_extract_all({text}, '{rx}')"
        counts.append(f"CAST(len({found}) AS BIGINT) AS {e.lower()}_count")
    red = text
    for e in PT.REDACT_ORDER:
        if e == "CREDIT_CARD":  # only numbers whose check digit holds
            red = f"list_reduce(list_prepend({red}, {_cards_sql(red)}), lambda text, card: replace(text, card, '[{e}]'))"
        else:
            red = f"regexp_replace({red}, '{PT.CONTENT_PATTERNS[e]}', '[{e}]', 'g')"
    return f"SELECT {id_col}, {', '.join(counts)}, sha256({red}) AS redacted FROM {src}"


def q_pii_text_redact_conversations(spark, d):
    conv = table(spark, d, "conversations")
    r = P.pii_text_redact(conv, "text", keep=["conv_id", "turn"])
    return r.withColumn("redacted", F.sha2("redacted", 256))


def q_pii_sensitivity_action(spark, d):
    """Entities found in the documents, with sensitivity and recommended action."""
    r = P.pii_text_redact(table(spark, d, "documents"), "text", keep=["doc_id"])
    ents = list(PT.CONTENT_PATTERNS)
    long = r.select(F.explode(F.array(*[F.struct(F.lit(e).alias("entity_type"),
                                                 F.col(e.lower() + "_count").alias("n"))
                                        for e in ents])).alias("s")).select("s.*")
    agg = long.groupBy("entity_type").agg(F.sum((F.col("n") > 0).cast("long")).alias("n_docs"),
                                          F.sum("n").alias("n_matches"))
    return P.pii_sensitivity_action(agg)


def _sens_sql():
    src = _redact_sql("documents", "doc_id", "text")
    sens = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PT.SENSITIVITY.items()) + " END"
    act = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PT.ACTION.items()) + " END"
    unions = " UNION ALL ".join(f"SELECT '{e}' AS entity_type, {e.lower()}_count AS n FROM r"
                                for e in PT.CONTENT_PATTERNS)
    return f"""
WITH r AS ({src}), l AS ({unions}),
a AS (SELECT entity_type, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs,
             CAST(sum(n) AS BIGINT) AS n_matches FROM l GROUP BY entity_type)
SELECT *, {sens} AS sensitivity, {act} AS recommended_action FROM a"""


QUERIES = {
    "pii_scan_table": q_pii_scan_table,
    "pii_scan_strict": q_pii_scan_strict,
    "pii_scan_by_name": q_pii_scan_by_name,
    "pii_scan_email": _entity_query("EMAIL"),
    "pii_scan_phone": _entity_query("PHONE"),
    "pii_scan_ssn": _entity_query("SSN"),
    "pii_scan_iban": _entity_query("IBAN"),
    "pii_scan_ip": _entity_query("IP_ADDRESS"),
    "pii_scan_credit_card": _entity_query("CREDIT_CARD"),
    "pii_risk_score": q_pii_risk_score,
    "pii_sample_mask": q_pii_sample_mask,
    "pii_sensitivity_action": q_pii_sensitivity_action,
    "pii_apply_mask": q_pii_apply_mask,
    "pii_apply_hash": q_pii_apply_hash,
    "pii_apply_pseudonymize": q_pii_apply_pseudonymize,
    "pii_apply_drop": q_pii_apply_drop,
    "pii_apply_approve": q_pii_apply_approve,
    "pii_apply_encrypt": q_pii_apply_encrypt,
    "pii_text_redact": q_pii_text_redact,
    "pii_text_redact_conversations": q_pii_text_redact_conversations,
}

ORACLE = {
    "pii_scan_table": _scan_sql(False),
    "pii_scan_strict": _scan_sql(True),
    "pii_scan_by_name": BY_NAME_SQL,
    "pii_scan_email": _entity_sql("EMAIL"),
    "pii_scan_phone": _entity_sql("PHONE"),
    "pii_scan_ssn": _entity_sql("SSN"),
    "pii_scan_iban": _entity_sql("IBAN"),
    "pii_scan_ip": _entity_sql("IP_ADDRESS"),
    "pii_scan_credit_card": _entity_sql("CREDIT_CARD"),
    "pii_risk_score": RISK_SQL,
    "pii_sample_mask": _samples_sql(),
    "pii_sensitivity_action": _sens_sql(),
    "pii_apply_mask": MASK_APPLY_SQL,
    "pii_apply_hash": HASH_APPLY_SQL,
    "pii_apply_pseudonymize": PSEUDO_SQL,
    "pii_apply_drop": DROP_SQL,
    "pii_apply_approve": APPROVE_SQL,
    "pii_apply_encrypt": ENCRYPT_SQL,
    "pii_text_redact": _redact_sql("documents", "doc_id", "text"),
    "pii_text_redact_conversations": _redact_sql("conversations", "conv_id, turn", "text"),
}
