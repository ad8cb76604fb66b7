"""PII scan and de-identification (survey §2.3).

``pii_scan_table`` evaluates every (column × pattern) test in one wide
aggregate, so a table is read once whatever its width; the first hit per
column is chosen with ``when`` chains on the tiny result.  Samples for the
flagged columns come from one more pass over only those columns.  The apply
operators are column expressions (mask, salted hash, keyed pseudonym, AES),
all built in and inside whole-stage codegen.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as PT
from ..functions.columns import chunks, mask_text, q
from ..functions.ordered import top_k_per_group


def name_entity(column: str, strict: bool = False) -> str | None:
    """Entity implied by a column name (schema only, no data).

    ``strict`` reproduces the reference's ``\\b`` rules, where ``customer_name``
    does not match because ``_`` is a word character (quirk Q1); by default
    underscores also separate words.
    """
    low = column.lower()
    candidates = [low] if strict else [low, low.replace("_", " ")]
    for rx, entity in PT.NAME_RULES:
        pat = re.compile(rx)
        if any(pat.search(c) for c in candidates):
            return entity
    return None


def card_hit(c: Column) -> Column:
    """Some 15-16 digit run in the value passes the Luhn check."""
    cands = F.regexp_extract_all(c, F.lit(PT.CREDIT_CARD), 0)
    return F.exists(cands, lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"[^0-9]", "")))


def entity_hit(entity: str, c: Column) -> Column:
    if entity == "CREDIT_CARD":
        return card_hit(c)
    return c.rlike(PT.CONTENT_PATTERNS[entity])


def _map_expr(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def pii_hits(df: DataFrame, strict: bool = False, max_exprs: int = 480) -> DataFrame:
    """(column_name, position, name_entity, non_null, <entity>_count...) for every column.

    String columns only by default; ``strict`` also scans other columns as text.
    """
    entities = list(PT.CONTENT_PATTERNS)
    fields = list(df.schema.fields)
    names = [f.name for f in fields]
    per_chunk = max(1, max_exprs // (len(entities) + 1))
    parts = []
    for ch in chunks(fields, per_chunk):
        if not ch:
            continue
        aggs = []
        structs = []
        for i, f in enumerate(ch):
            scan = strict or isinstance(f.dataType, T.StringType)
            c = F.col(q(f.name)).cast("string")
            aggs.append(F.count(F.col(q(f.name))).alias(f"n{i}"))
            for e in entities:
                expr = F.sum(entity_hit(e, c).cast("long")) if scan else F.lit(None).cast("long")
                aggs.append(expr.alias(f"h{i}_{e}"))
            structs.append(F.struct(
                F.lit(f.name).alias("column_name"), F.lit(names.index(f.name)).cast("long").alias("position"),
                F.lit(name_entity(f.name, strict)).cast("string").alias("name_entity"),
                F.col(f"n{i}").cast("long").alias("non_null"),
                *[F.coalesce(F.col(f"h{i}_{e}"), F.lit(0)).cast("long").alias(e.lower() + "_count")
                  for e in entities]))
        wide = df.agg(*aggs)
        parts.append(wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pii_scan_table(df: DataFrame, strict: bool = False, min_pct: float = 0.05) -> DataFrame:
    """One row per flagged column: entity, sensitivity, count, share, action, status.

    Name rules win (share 1.0, count = non-null); otherwise the first content
    pattern matching at least ``min_pct`` of the non-null values.
    """
    hits = pii_hits(df, strict)
    order = PT.STRICT_ORDER if strict else PT.DEFAULT_ORDER
    nn = F.col("non_null")
    ent = F.when((F.col("name_entity").isNotNull()) & (nn > 0), F.col("name_entity"))
    cnt = F.when((F.col("name_entity").isNotNull()) & (nn > 0), nn)
    for e in order:
        c = F.col(e.lower() + "_count")
        ok = (nn > 0) & (c / nn >= min_pct)
        ent = ent.when(ok, F.lit(e))
        cnt = cnt.when(ok, c)
    scored = hits.select("column_name", "position", ent.alias("entity_type"), cnt.alias("match_count"),
                         F.when(F.col("name_entity").isNotNull(), F.lit(1.0))
                         .otherwise(F.round(cnt / nn, 4)).alias("match_pct"))
    return scored.where(F.col("entity_type").isNotNull()).select(
        "column_name", "position", "entity_type",
        _map_expr(PT.SENSITIVITY)[F.col("entity_type")].alias("sensitivity"),
        F.col("match_count").cast("long").alias("match_count"), "match_pct",
        _map_expr(PT.ACTION)[F.col("entity_type")].alias("recommended_action"),
        F.lit("pending").alias("status"))


def pii_sensitivity_action(entities: DataFrame, col: str = "entity_type") -> DataFrame:
    """Attach sensitivity and recommended action to any frame with an entity column."""
    return entities.select("*", _map_expr(PT.SENSITIVITY)[F.col(col)].alias("sensitivity"),
                           _map_expr(PT.ACTION)[F.col(col)].alias("recommended_action"))


def pii_risk_score(findings: DataFrame, n_columns: int) -> DataFrame:
    """``min(100, round(Σ weight / (3 · ncols) · 100))`` with half-even rounding."""
    w = _map_expr({k: v for k, v in PT.RISK_WEIGHT.items()})[F.col("sensitivity")]
    denom = float(3 * n_columns if n_columns > 0 else 1)
    agg = findings.agg(F.sum(w).alias("raw"), F.count(F.lit(1)).alias("n_findings"))
    score = F.least(F.lit(100), F.bround(F.coalesce(F.col("raw"), F.lit(0)) / denom * 100, 0).cast("long"))
    return agg.select(F.lit(n_columns).cast("long").alias("total_columns"),
                      F.col("n_findings").cast("long").alias("n_findings"),
                      score.cast("long").alias("risk_score"))


def pii_samples(df: DataFrame, findings: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` masked sample values per flagged column (smallest matching values).

    Only the flagged columns are unpivoted; ranking uses the salted top-k.
    """
    rows = findings.select("column_name", "entity_type").collect()  # one row per flagged column
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, sample string")
    cols = [r["column_name"] for r in rows]
    ent = {r["column_name"]: r["entity_type"] for r in rows}
    structs = []
    for c in cols:
        v = F.col(q(c)).cast("string")
        if ent[c] in PT.CONTENT_PATTERNS:
            v = F.when(entity_hit(ent[c], v), v)
        structs.append(F.struct(F.lit(c).alias("column_name"), v.alias("value")))
    long = (df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
            .where(F.col("value").isNotNull()).distinct())
    top = top_k_per_group(long, ["column_name"], [F.asc("value")], k)
    return top.select("column_name", "rank", mask_text(F.col("value")).alias("sample"))


# ------------------------------------------------------------------ apply actions
def pii_apply_mask(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: mask_text(F.col(q(c))) for c in columns})


def pii_apply_hash(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Salted sha256; without a secret salt short values such as card or social security numbers
    could be found by trying them all."""
    if not salt:
        raise ValueError("hashing personal data needs a salt")
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(q(c)).cast("string")), 256)
                           for c in columns})


def pii_apply_pseudonymize(df: DataFrame, columns: list[str], key: str,
                           prefix: str | None = None) -> DataFrame:
    """Stable token per value: prefix + first 128 bits of sha256(key || value) in hex; the key is the caller's secret."""
    if not key:
        raise ValueError("pseudonyms of personal data need a key")
    out = {}
    for c in columns:
        p = prefix if prefix is not None else c.upper()[:4] + "_"
        h = F.sha2(F.concat(F.lit(key), F.col(q(c)).cast("string")), 256)
        out[c] = F.when(F.col(q(c)).isNull(), None).otherwise(F.concat(F.lit(p), F.substring(h, 1, 32)))
    return df.withColumns(out)


def pii_apply_encrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Reversible AES (GCM) encryption, base64 text; see ``pii_decrypt``."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(q(c)).cast("string"), F.lit(key)))
                           for c in columns})


def pii_decrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.unbase64(F.col(q(c))), F.lit(key)).cast("string")
                           for c in columns})


def pii_apply_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def pii_apply_approve(df: DataFrame, columns: list[str]) -> DataFrame:
    return df


APPLY = {"mask": pii_apply_mask, "hash": pii_apply_hash, "pseudonymize": pii_apply_pseudonymize,
         "drop": pii_apply_drop, "approve": pii_apply_approve}


KEYED = ("encrypt", "pseudonymize", "hash")


def pii_apply(df: DataFrame, actions: dict[str, str], key: str | None = None) -> DataFrame:
    """Apply ``{column: action}`` in one projection; hash, pseudonymize and encrypt need the caller's ``key``."""
    if not key and any(act in KEYED for act in actions.values()):
        raise ValueError("hashing, pseudonyms and encryption need a key")
    for col, act in actions.items():
        if col not in df.columns:
            raise ValueError(f"unknown column {col!r}")
        if act == "encrypt":
            df = pii_apply_encrypt(df, [col], key)
        elif act in ("pseudonymize", "hash"):
            df = APPLY[act](df, [col], key)
        elif act in APPLY:
            df = APPLY[act](df, [col])
        else:
            raise ValueError(f"unknown action {act!r}")
    return df


# ------------------------------------------------------------------ free text
def luhn_valid(candidate):
    return F.call_function("luhn_check", F.regexp_replace(candidate, r"[^0-9]", ""))


def pii_text_redact(df: DataFrame, text_col: str, keep: list[str] = ()) -> DataFrame:
    """Per row: count of each entity in the text and the text with entities replaced.

    Only Luhn-valid card candidates are counted and replaced; redaction runs in
    ``REDACT_ORDER`` so e-mail digits are not re-read as phones.
    """
    t = F.col(q(text_col))
    counts = {}
    for e, rx in PT.CONTENT_PATTERNS.items():
        found = F.regexp_extract_all(t, F.lit(rx), 0)
        if e == "CREDIT_CARD":
            found = F.filter(found, luhn_valid)
        counts[e.lower() + "_count"] = F.size(found).cast("long")
    red = t
    for e in PT.REDACT_ORDER:
        if e == "CREDIT_CARD":
            # by place: the same digits within a longer number elsewhere stay
            found, between = F.regexp_extract_all(red, F.lit(PT.CREDIT_CARD), 0), F.split(red, PT.CREDIT_CARD, -1)
            red = F.array_join(F.zip_with(between, found, lambda text, card: F.concat(
                text, F.when(card.isNull(), "").when(luhn_valid(card), f"[{e}]").otherwise(card))), "")  # noqa: B023
        else:
            red = F.regexp_replace(red, PT.CONTENT_PATTERNS[e], f"[{e}]")
    return df.select(*keep, *[v.alias(k) for k, v in counts.items()], red.alias("redacted"))
