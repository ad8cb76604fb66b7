"""Feature engineering (survey §2.9).

``feature_apply`` turns a spec list into one statistics aggregate plus one
``select``.  Categorical encodings never collect values per row: one-hot
needs the (bounded, checked) category list; label codes come from a
distributed sort of distinct values with ``zipWithIndex`` and are joined back,
broadcast while they are at most ``BROADCAST_CODES``.  TF-IDF is an explode / groupBy plan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..functions.columns import column_quantiles, nan_to_null, q
from ..functions.text import tokens, with_bigrams

MISSING = "missing"
TARGET_SMOOTHING = 10.0
BROADCAST_CODES = 200_000  # label codes that travel to every task; a larger table is joined by shuffle


def _stats(df: DataFrame, cols: dict[str, set]) -> dict:
    aggs = []
    for c, kinds in cols.items():
        x = F.col(q(c)).cast("double")
        for k in sorted(kinds - {"median"}):
            fn = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop}[k]
            aggs.append(fn(x).alias(f"{k}|{c}"))
    out = {}
    if aggs:
        row = df.agg(*aggs).first().asDict()
        out = {tuple(k.split("|", 1)[::-1]): v for k, v in row.items()}
    med = [c for c, kinds in cols.items() if "median" in kinds]
    if med:
        qs = column_quantiles(df, med, [0.5])
        out.update({(c, "median"): qs[(c, 0.5)] for c in med})
    return out


def fe_log(x: Column, mn: float | None) -> Column:
    shift = abs(mn) + 1 if mn is not None and mn <= 0 else 0.0
    return F.log1p(F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(float(shift)))


def fe_sqrt(x: Column, mn: float | None) -> Column:
    shift = abs(mn) if mn is not None and mn < 0 else 0.0
    return F.sqrt(F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(float(shift)))


def fe_standard_scale(x: Column, mean, std) -> Column:
    x = x.cast("double")
    if std and std > 0:
        return (F.coalesce(x, F.lit(mean)) - F.lit(mean)) / F.lit(std)
    return F.coalesce(x, F.lit(0.0))


def fe_min_max_scale(x: Column, mn, mx) -> Column:
    x = x.cast("double")
    if mn is not None and mx is not None and mx > mn:
        return (F.coalesce(x, F.lit(mn)) - F.lit(mn)) / F.lit(mx - mn)
    return F.coalesce(x, F.lit(0.0))


def fe_date_parts(c: Column, dtype: T.DataType, out: str) -> list[Column]:
    ts = c if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.try_to_timestamp(c.cast("string"))
    return [F.coalesce(F.year(ts), F.lit(0)).alias(f"{out}_year"),
            F.coalesce(F.month(ts), F.lit(0)).alias(f"{out}_month"),
            F.coalesce(F.dayofmonth(ts), F.lit(0)).alias(f"{out}_day"),
            F.coalesce(F.weekday(ts), F.lit(0)).alias(f"{out}_dow")]


def category_values(df: DataFrame, col: str, limit: int | None = None) -> list[str]:
    """Sorted categories (null as 'missing'): they become columns, so the caller may set a ``limit``."""
    v = F.coalesce(F.col(q(col)).cast("string"), F.lit(MISSING))
    found = df.select(v.alias("v")).distinct()
    vals = [r[0] for r in (found if limit is None else found.limit(limit + 1)).collect()]
    if limit is not None and len(vals) > limit:
        raise ValueError(f"{col}: more than {limit} categories; use fe_one_hot_vector, label or target encoding")
    return sorted(vals)


def fe_one_hot(df: DataFrame, col: str, out: str, values: list[str] | None = None, limit: int | None = None) -> list[Column]:
    """One 0/1 column per category; for very many categories see ``fe_one_hot_vector``."""
    values = values if values is not None else category_values(df, col, limit)
    v = F.coalesce(F.col(q(col)).cast("string"), F.lit(MISSING))
    return [(v == F.lit(x)).cast("int").alias(f"{out}_{x}") for x in values]


def fe_one_hot_vector(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with one sparse 0/1 vector in place of a column per category (alphabetical, null as 'missing')."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    v = F.coalesce(F.col(q(col)).cast("string"), F.lit(MISSING))
    pipe = Pipeline(stages=[StringIndexer(inputCol="__v", outputCol="__i", stringOrderType="alphabetAsc"),
                            OneHotEncoder(inputCol="__i", outputCol=out, dropLast=False)])
    rows = df.withColumn("__v", v)
    return pipe.fit(rows).transform(rows).drop("__v", "__i")


def label_codes(df: DataFrame, cols: list[str], missing: str = MISSING) -> DataFrame:
    """(column_name, value, code): alphabetical codes per column, computed in the JVM.

    Distinct (column, value) pairs are range-sorted; ``monotonically_increasing_id``
    gives each row its partition (high bits) and position inside it (low 33 bits);
    a small (column, partition) table of counts turns positions into per-column
    ranks.  No value passes through Python and no column is ranked in one task.
    """
    long = (df.select(*[F.coalesce(F.col(q(c)).cast("string"), F.lit(missing)).alias(c) for c in cols])
            .unpivot([], cols, "column_name", "value").distinct().orderBy("column_name", "value"))
    mid = F.monotonically_increasing_id()
    tagged = long.select("column_name", "value", F.shiftright(mid, 33).alias("__pid"),
                         mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"))
    # positions depend on the sort's range bounds: they are fixed in the shared checkpoint folder,
    # so a lost block is read again, never computed with other bounds
    ensure_checkpoint_dir(df.sparkSession)
    tagged = tagged.checkpoint()
    per = tagged.groupBy("column_name", "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    w = Window.partitionBy("column_name").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("column_name", "__pid", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (tagged.join(offs, ["column_name", "__pid"])  # columns x sort partitions: Spark sees the size
            .select("column_name", "value", (F.col("__off") + F.col("__pos") - F.col("__first")).cast("int").alias("code")))


def few(codes: DataFrame) -> DataFrame:
    """``codes`` with a broadcast hint while they are few.

    Spark does not know the size of a checkpoint.  Without the hint it sends the rows to their codes: all
    rows of a value to one task, or a small enough table whole to every task.
    """
    found = codes.limit(BROADCAST_CODES + 1).count()
    return F.broadcast(codes) if found <= BROADCAST_CODES else codes


def fe_label_encode(df: DataFrame, cols: list[str], outputs: dict[str, str] | None = None,
                    missing: str = MISSING) -> DataFrame:
    """Replace (or add, via ``outputs``) alphabetical codes for string columns."""
    outputs = outputs or {c: c for c in cols}
    codes = label_codes(df, cols, missing)
    out = df
    for c in cols:
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
        out = (out.withColumn("__v", F.coalesce(F.col(q(c)).cast("string"), F.lit(missing)))
               .join(few(m), "__v", "left").drop("__v"))
        out = out.withColumn(outputs[c], F.col("__code")).drop("__code")
    return out


def fe_bin(x: Column, edges: list[float]) -> Column:
    """Bin index = number of inner edges strictly below x (null stays null)."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    xd = x.cast("double")
    return F.when(xd.isNull(), None).otherwise(F.size(F.filter(arr, lambda e: e < xd)))


def equal_width_edges(mn: float, mx: float, bins: int) -> list[float]:
    if mn is None or mx is None or mx <= mn:
        return []
    return [mn + (mx - mn) * i / bins for i in range(1, bins)]


def fe_polynomial(cols: list[str], degree: int = 2) -> list[Column]:
    """Squares (and cubes for degree 3) of each column and products of pairs."""
    out = []
    for c in cols:
        for d in range(2, degree + 1):
            out.append(F.pow(F.col(q(c)).cast("double"), d).alias(f"{c}_pow{d}"))
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append((F.col(q(a)).cast("double") * F.col(q(b)).cast("double")).alias(f"{a}_x_{b}"))
    return out


def fe_interaction(a: str, b: str, out: str | None = None) -> Column:
    return (F.col(q(a)).cast("double") * F.col(q(b)).cast("double")).alias(out or f"{a}_x_{b}")


def fe_target_encode(df: DataFrame, col: str, target: str, fold_col: str,
                     smoothing: float = TARGET_SMOOTHING, out: str | None = None) -> DataFrame:
    """Out-of-fold smoothed target mean per category.

    For a row in fold f: (Σy − Σy_f + m·prior) / (n − n_f + m) over its category,
    where prior is the mean of y outside fold f.  Totals per (category, fold)
    are a small grouped frame; rows are never compared with each other.
    """
    out = out or f"{col}_te"
    v = F.coalesce(F.col(q(col)).cast("string"), F.lit(MISSING))
    y = F.col(q(target)).cast("double")
    cf = df.groupBy(v.alias("__cat"), F.col(fold_col).alias("__fold")).agg(F.sum(y).alias("sy"), F.count(y).alias("n"))
    cat_tot = cf.groupBy("__cat").agg(F.sum("sy").alias("sy_c"), F.sum("n").alias("n_c"))
    fold_tot = cf.groupBy("__fold").agg(F.sum("sy").alias("sy_f"), F.sum("n").alias("n_f"))
    all_tot = cf.agg(F.sum("sy").alias("sy_a"), F.sum("n").alias("n_a"))
    enc = (cf.join(cat_tot, "__cat").join(F.broadcast(fold_tot), "__fold")
           .withColumn("__k", F.lit(0)).join(F.broadcast(all_tot.withColumn("__k", F.lit(0))), "__k").drop("__k"))
    prior = (F.col("sy_a") - F.col("sy_f")) / (F.col("n_a") - F.col("n_f"))
    val = ((F.col("sy_c") - F.col("sy")) + smoothing * prior) / ((F.col("n_c") - F.col("n")) + smoothing)
    enc = enc.select("__cat", "__fold", val.alias(out))
    return (df.withColumn("__cat", v).withColumn("__fold", F.col(fold_col))
            .join(enc, ["__cat", "__fold"], "left").drop("__cat", "__fold"))


def fe_lags(df: DataFrame, value: str, order: str, lags: int = 12, series: list[str] = (),
            drop_incomplete: bool = True, method: str = "join") -> DataFrame:
    """lag_1..lag_k of ``value`` per series ordered by ``order``; rows with a missing lag dropped.

    ``method="window"`` is a per-series window (for many small series).
    ``method="join"`` is skew-safe: exact positions come from the bucketed running
    count per series and each row is joined to the rows 1..k positions earlier on
    (series, position), so even a series holding a third of all rows is spread
    over many tasks.  ``order`` must be unique within a series.
    """
    if method == "window":
        w = Window.partitionBy(*series).orderBy(order) if series else Window.orderBy(order)
        out = df.select("*", *[F.lag(F.col(q(value)), i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)])
    elif method == "join":
        from ..functions.ordered import cumulative_sum
        keys = list(series) or ["__all"]
        base = df if series else df.withColumn("__all", F.lit(0))
        t = base.withColumn("__o", F.col(q(order)).cast("timestamp").cast("double")
                            if not isinstance(base.schema[order].dataType, (T.NumericType,)) else F.col(q(order)).cast("double"))
        t = t.withColumn("__one", F.lit(1).cast("long"))
        pos = cumulative_sum(t, "__o", ["__one"], partition_cols=keys).withColumnRenamed("__one_cum", "__pos")
        pos = pos.drop("__one", "__o")
        ahead = pos.select(*keys, F.col(q(value)).alias("__y"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("__i"),
                           "__pos").select(*keys, "__y", "__i", (F.col("__pos") + F.col("__i")).alias("__pos"))
        lagged = ahead.groupBy(*keys, "__pos").agg(*[F.max(F.when(F.col("__i") == i, F.col("__y"))).alias(f"lag_{i}")
                                                     for i in range(1, lags + 1)])
        out = pos.join(lagged, keys + ["__pos"], "left").drop("__pos")
        if not series:
            out = out.drop("__all")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.dropna(subset=[f"lag_{i}" for i in range(1, lags + 1)]) if drop_incomplete else out


# ------------------------------------------------------------------ TF-IDF
def tfidf(df: DataFrame, text_col: str, id_col: str, ngram_max: int = 2, min_df: int = 2,
          max_features: int = 10000, sublinear_tf: bool = True) -> DataFrame:
    """(doc id, term, weight): scikit-learn's TfidfVectorizer semantics as a plan.

    Accents stripped, lower-cased, Unicode word tokens of 2+ chars, uni+bigrams,
    terms in ≥ ``min_df`` docs, the ``max_features`` most frequent terms
    (ties by term), tf = 1 + ln(count), idf = ln((1 + n)/(1 + df)) + 1, L2 per doc.
    """
    tok = df.select(F.col(q(id_col)).alias("doc"), tokens(F.col(q(text_col))).alias("__toks"))
    terms = with_bigrams(F.col("__toks")) if ngram_max >= 2 else F.col("__toks")
    n_docs = df.agg(F.count(F.lit(1)).alias("n_docs"))
    # one shuffle by term, combined in the tasks: occurrences, and documents from each row's distinct terms
    one = F.concat(F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("cf"), F.lit(0).alias("df"))),
                   F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df"))))
    stats = (tok.select(F.explode(one).alias("s")).groupBy("s.term").agg(F.sum("s.df").alias("df"), F.sum("s.cf").alias("cf"))
             .where(F.col("df") >= min_df))
    vocab = stats.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)  # bounded by max_features
    idf = (vocab.withColumn("__k", F.lit(0)).join(F.broadcast(n_docs.withColumn("__k", F.lit(0))), "__k")
           .select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")))
    # only vocabulary terms travel, once, to their document; counting and the norm need no further shuffle
    known = tok.select("doc", F.explode(terms).alias("term")).join(F.broadcast(idf), "term").repartition("doc")
    tf = known.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    w = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    raw = tf.select("doc", "term", (w * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select(F.col("doc").alias(id_col), "term", (F.col("raw") / norm).alias("weight"))


def tfidf_top_terms(weights: DataFrame, n_docs: DataFrame, top: int = 20) -> DataFrame:
    """Terms with the highest mean weight over all documents (zeros included)."""
    s = weights.groupBy("term").agg(F.sum("weight").alias("s"))
    return (s.withColumn("__k", F.lit(0)).join(F.broadcast(n_docs.withColumn("__k", F.lit(0))), "__k")
            .select("term", (F.col("s") / F.col("n_docs")).alias("score"))
            .orderBy(F.desc("score"), F.asc("term")).limit(top))


# ------------------------------------------------------------------ spec application
TRANSFORMS = {"log", "sqrt", "standard_scale", "min_max_scale", "one_hot_encode", "label_encode",
              "date_parts", "none"}


def feature_apply(df: DataFrame, specs, target: str | None = None) -> DataFrame:
    """Run the enabled specs, keep only their outputs, append the target last.

    ``specs``: rows/dicts with source_column(s), output_name, transform, enabled.
    One aggregate collects every min/max/mean/std the specs need.
    """
    df = nan_to_null(df)
    norm = []
    for s in specs:
        d = s.asDict() if hasattr(s, "asDict") else dict(s)
        if not d.get("enabled", True):
            continue
        src = d.get("source_column") or (d.get("source_columns") or [None])[0]
        if d["transform"] not in TRANSFORMS:
            raise ValueError(f"unknown transform {d['transform']!r}")
        if src not in df.columns:
            raise ValueError(f"unknown column {src!r}")
        norm.append((src, d.get("output_name") or src, d["transform"]))
    need = {}
    for src, _, t in norm:
        k = {"log": {"min"}, "sqrt": {"min"}, "standard_scale": {"mean", "std"},
             "min_max_scale": {"min", "max"}}.get(t)
        if k:
            need.setdefault(src, set()).update(k)
    st = _stats(df, need)
    label_cols = [src for src, _, t in norm if t == "label_encode"]
    work = df
    if label_cols:
        work = fe_label_encode(df, label_cols, {c: f"__code_{c}" for c in label_cols})
    out = []
    for src, name, t in norm:
        x = F.col(q(src))
        if t == "log":
            out.append(fe_log(x, st.get((src, "min"))).alias(name))
        elif t == "sqrt":
            out.append(fe_sqrt(x, st.get((src, "min"))).alias(name))
        elif t == "standard_scale":
            out.append(fe_standard_scale(x, st.get((src, "mean")), st.get((src, "std"))).alias(name))
        elif t == "min_max_scale":
            out.append(fe_min_max_scale(x, st.get((src, "min")), st.get((src, "max"))).alias(name))
        elif t == "one_hot_encode":
            out += fe_one_hot(df, src, name)
        elif t == "label_encode":
            out.append(F.col(f"__code_{src}").alias(name))
        elif t == "date_parts":
            out += fe_date_parts(x, df.schema[src].dataType, name)
        else:
            out.append(x.alias(name))
    if target and target in df.columns:
        out.append(F.col(q(target)))
    return work.select(*out)


def prep_matrix(df: DataFrame, features: list[str], target: str, scale: bool = False) -> DataFrame:
    """Encoded numeric matrix: strings → '__missing__' + alphabetical codes; numbers →
    cast (failures null) then median-filled; optional standard scaling with the
    population std (as scikit-learn's StandardScaler).  Rows with a null target dropped."""
    df = nan_to_null(df).where(F.col(q(target)).isNotNull())
    strs = [c for c in features if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]
    nums = [c for c in features if c not in strs]
    med = _stats(df, {c: {"median"} for c in nums})
    work = fe_label_encode(df, strs, {c: c for c in strs}, missing="__missing__") if strs else df
    cols = {c: F.coalesce(F.col(q(c)).cast("double"), F.lit(med.get((c, "median"))).cast("double")) for c in nums}
    cols.update({c: F.col(q(c)).cast("double") for c in strs})
    work = work.select(*[cols[c].alias(c) for c in features], F.col(q(target)))
    if scale:
        sp = _stats(work, {c: {"mean", "std_pop"} for c in features})
        work = work.select(*[((F.col(q(c)) - F.lit(sp[(c, "mean")])) /
                              F.lit(sp[(c, "std_pop")] if sp[(c, "std_pop")] else 1.0)).alias(c)
                             for c in features], F.col(q(target)))
    return work
