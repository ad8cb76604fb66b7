"""Profiling (survey §2.4): per-column statistics as DataFrames.

Plan shape: one wide aggregate for moments / counts (partial + final agg,
no shuffle of rows), one value count (column by column, or for wide tables ``unpivot``
then ``groupBy(column, head, hash)``) shared by unique counts, top values and modes,
and one bucketed count for histograms.  Nothing row-sized reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (chunks, finite_or_null, is_datetime, is_numeric,
                                 is_scalar, nan_to_null, q, sample_kurtosis,
                                 sample_skewness)
from ..functions.ordered import top_k_per_group
from .metric_tree import kept

# Thresholds and labels used by the reference profiler.
HIGH_MISSING = 0.3
NEAR_ZERO_STD = 0.01
HIGH_CARDINALITY = 0.95
TEXT_AVG_LEN = 50
WARN_MISSING = "High missing values"
WARN_LOW_VAR = "Near-zero variance"
WARN_HIGH_CARD = "High cardinality"

# Shapes accepted as dates in string columns before `try_to_timestamp` (quirk Q16:
# a bare year or a short number is not a date).
DATE_SHAPE = (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
              r"|^\d{4}/\d{1,2}/\d{1,2}$")

STAT_COLS = ["n_nonnull", "mean", "std", "min", "max", "skew_pop", "kurt_pop",
             "n_date", "avg_len", "dt_min", "dt_max"]


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def parsed_timestamp(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(DATE_SHAPE), F.try_to_timestamp(s))


def _column_stats(name: str, dt: T.DataType) -> list[Column]:
    c = F.col(q(name))
    kind = _kind(dt)
    none_d = F.lit(None).cast("double")
    none_s = F.lit(None).cast("string")
    none_l = F.lit(None).cast("long")
    if kind == "numeric":
        x = c.cast("double")
        stats = [F.count(c), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x),
                 F.skewness(x), F.kurtosis(x), none_l, none_d, none_s, none_s]
    elif kind == "string":
        ts = parsed_timestamp(c)
        stats = [F.count(c), none_d, none_d, none_d, none_d, none_d, none_d,
                 F.count(ts), F.avg(F.length(c)).cast("double"),
                 F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss"),
                 F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss")]
    elif kind == "datetime":
        stats = [F.count(c), none_d, none_d, none_d, none_d, none_d, none_d, none_l, none_d,
                 F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss"),
                 F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss")]
    else:
        stats = [F.count(c), none_d, none_d, none_d, none_d, none_d, none_d, none_l, none_d,
                 none_s, none_s]
    return stats


STATS_AT_ONCE = 4  # columns of one aggregate: the loop over rows of a wider one is too long for the JVM to compile
STATS_SCANS = 32   # aggregates of one table, unless that makes them wider than max_exprs


def column_stats(df: DataFrame, columns: list[str] | None = None,
                 max_exprs: int = 480) -> DataFrame:
    """Long frame: one row per column with raw aggregate statistics.

    Each chunk of columns is one aggregate job that reads these columns only; the one-row result is turned
    into rows with ``stack`` lazily, so no Python loop over data.
    """
    df = nan_to_null(df)
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    per_chunk = max(1, min(max_exprs // len(STAT_COLS), max(STATS_AT_ONCE, -(-len(fields) // STATS_SCANS))))
    parts = []
    for ch in chunks(fields, per_chunk):
        if not ch:
            continue
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, f in enumerate(ch):
            for j, e in enumerate(_column_stats(f.name, f.dataType)):
                aggs.append(e.alias(f"s{i}_{j}"))
        wide = df.agg(*aggs)
        structs = []
        for i, f in enumerate(ch):
            pos = [fl.name for fl in df.schema.fields].index(f.name)
            structs.append(F.struct(
                F.lit(f.name).alias("column_name"), F.lit(pos).cast("long").alias("position"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(_kind(f.dataType)).alias("kind"),
                F.col("__n").alias("n_rows"),
                *[F.col(f"s{i}_{j}").alias(STAT_COLS[j]) for j in range(len(STAT_COLS))]))
        parts.append(wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


HEAD = 32  # characters of a value that travel with its count


def _long(f: T.StructField) -> bool:
    """Whether a value of the column may be longer than HEAD as text."""
    return isinstance(f.dataType, (T.StringType, T.BinaryType, T.DecimalType))


def _cell(f: T.StructField) -> dict[str, Column]:
    v = F.col(q(f.name)).cast("string")
    none = F.lit(0).cast("long")
    if not _long(f):
        return {"head": v, "h1": none, "h2": none}
    cut = lambda h: F.when(F.length(v) > HEAD, h).otherwise(none)
    return {"head": F.substring(v, 1, HEAD), "h1": cut(F.xxhash64(v)), "h2": cut(F.xxhash64(F.lit(1), v))}


def _cells(df: DataFrame, fields: list[T.StructField], whole: bool = False) -> DataFrame:
    """(column_name, head, h1, h2[, value]) of every value; the hashes are 0 for a value that its head holds."""
    cells = [F.struct(*[x.alias(n) for n, x in _cell(f).items()], *([F.col(q(f.name)).cast("string").alias("value")] if whole else []))
             .alias(f.name) for f in fields]
    return df.select(*cells).unpivot([], [q(f.name) for f in fields], "column_name", "cell").select("column_name", "cell.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, head, h1, h2, count) of the different values of all scalar columns, as text.

    A value is told apart by its first HEAD characters and, if it is longer, a 128-bit hash, so whole
    texts are never shuffled; ``with_text`` fetches those of a few values.  Up to COUNTS_SCANS columns
    are counted one by one, those of a wider table by one shuffle for all; map-side combine absorbs hot values.
    """
    df = nan_to_null(df)
    fields = [f for f in df.schema.fields if is_scalar(f.dataType) and (columns is None or f.name in columns)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, head string, h1 long, h2 long, count long")
    parts = []
    if len(fields) <= COUNTS_SCANS:
        parts, fields = [_column_counts(df, f) for f in fields], []
    for kind in NATIVE:
        plain = [f for f in fields if isinstance(f.dataType, kind)]
        if plain:
            parts.append(_native_counts(df, plain, kind))
    rest = [f for f in fields if not isinstance(f.dataType, tuple(t for kind in NATIVE for t in kind))]
    if rest:
        cells = _cells(df, rest).where(F.col("head").isNotNull())
        parts.append(cells.groupBy("column_name", "head", "h1", "h2").agg(F.count(F.lit(1)).alias("count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COUNTS_SCANS = 32  # columns up to which each is counted by itself


def _column_counts(df: DataFrame, f: T.StructField) -> DataFrame:
    """Value counts of one column: reads that column only, and a row costs one short key."""
    name, none = F.lit(f.name).alias("column_name"), F.lit(0).cast("long")
    c = F.col(q(f.name))
    if not any(isinstance(f.dataType, kind) for kind in NATIVE):
        cells = df.select(*[x.alias(n) for n, x in _cell(f).items()]).where(F.col("head").isNotNull())
        return cells.groupBy("head", "h1", "h2").agg(F.count(F.lit(1)).alias("count")).select(name, "head", "h1", "h2", "count")
    keys, text = ["v"], F.col("v").cast("string")
    cells = df.select(c.alias("v")).where(F.col("v").isNotNull())
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        # grouping takes a negative zero for zero; its text differs
        cells = cells.withColumn("minus", (F.col("v") == 0) & (F.col("v").cast("string") == "-0.0"))
        keys, text = ["v", "minus"], F.when(F.col("minus"), "-0.0").otherwise(text)
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).select(
        name, text.alias("head"), none.alias("h1"), none.alias("h2"), "count")


# Types whose different values have different texts, by the type that holds them all: these are counted
# as they are and only the different ones become text.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NATIVE = (WHOLE, (T.DoubleType,), (T.FloatType,), (T.DateType,), (T.TimestampNTZType,), (T.BooleanType,))


def _native_counts(df: DataFrame, fields: list[T.StructField], kind: tuple) -> DataFrame:
    """Value counts of columns of one kind, grouped by value; a negative zero has a text of its own."""
    value = lambda f: F.col(q(f.name)).cast("long") if kind is WHOLE else F.col(q(f.name))
    cells = df.select(*[value(f).alias(f.name) for f in fields]).unpivot(
        [], [q(f.name) for f in fields], "column_name", "v").where(F.col("v").isNotNull())
    keys = ["column_name", "v"]
    text = F.col("v").cast("string")
    if kind in ((T.DoubleType,), (T.FloatType,)):
        cells = cells.withColumn("minus", (F.col("v") == 0) & (text == "-0.0"))
        keys, text = [*keys, "minus"], F.when(F.col("minus"), "-0.0").otherwise(text)
    none = F.lit(0).cast("long")
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).select(
        "column_name", text.alias("head"), none.alias("h1"), none.alias("h2"), "count")


def with_text(df: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (rows of ``value_counts``) with the whole ``value`` in place of head and hashes.

    The long ones are looked up in ``df`` by their hashes; only their texts are shuffled, and only
    columns with such values are read again.
    """
    df = nan_to_null(df)
    named = values.schema.names
    rest = [c for c in named if c not in ("head", "h1", "h2")]
    fields = [f for f in df.schema.fields if is_scalar(f.dataType) and _long(f)]
    wanted = values.where("h1 <> 0 or h2 <> 0").select("column_name", "h1", "h2")
    if fields:
        cut = {r[0] for r in wanted.select("column_name").distinct().collect()}  # column names only
        fields = [f for f in fields if f.name in cut]
    if not fields:
        return values.select(*rest, F.col("head").alias("value"))
    cells = _cells(df, fields, whole=True).where("h1 <> 0 or h2 <> 0").drop("head")
    texts = (cells.join(wanted, ["column_name", "h1", "h2"], "left_semi")
             .groupBy("column_name", "h1", "h2").agg(F.min("value").alias("text")))
    return (values.join(texts, ["column_name", "h1", "h2"], "left")
            .select(*rest, F.coalesce("text", "head").alias("value")))


def count_sizes(counts: DataFrame) -> DataFrame:
    """(column_name, count, n): how many values of a column come ``count`` times; far fewer rows than values."""
    return counts.groupBy("column_name", "count").agg(F.count(F.lit(1)).alias("n"))


def profile_unique(df: DataFrame, columns: list[str] | None = None,
                   counts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    if sizes is not None:
        return sizes.groupBy("column_name").agg(F.sum("n").alias("unique_count"))
    vc = counts if counts is not None else value_counts(df, columns)
    return vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))


def profile_top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None,
                       counts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Top ``k`` values per column by count, ties broken by value.

    The count of the k-th is known from ``count_sizes``, so only values that come as often are ranked.
    Heads order like whole values, so the k-th by (count, head) bounds the top; values that tie with
    it in both are told apart by their texts.
    """
    vc = counts if counts is not None else kept(value_counts(df, columns))
    before = F.sum("n").over(Window.partitionBy("column_name").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    least = (sizes if sizes is not None else count_sizes(vc)).withColumn("before", F.coalesce(before, F.lit(0)))
    least = least.where(F.col("before") < k).groupBy("column_name").agg(F.min("count").alias("least"))  # a row per column
    often = vc.join(F.broadcast(least), "column_name").where(F.col("count") >= F.col("least")).select(*vc.columns)
    by_head = top_k_per_group(often, ["column_name"], [F.desc("count"), F.asc("head"), F.asc("h1"), F.asc("h2")], k)
    if any(_long(f) for f in df.schema.fields):
        last = by_head.groupBy("column_name").agg(F.max_by(F.struct("count", "head"), "rank").alias("last"))  # a row per column
        top = vc.join(F.broadcast(last), "column_name").where(
            (F.col("count") > F.col("last.count")) | ((F.col("count") == F.col("last.count")) & (F.col("head") <= F.col("last.head"))))
        return top_k_per_group(with_text(df, kept(top.drop("last"))), ["column_name"], [F.desc("count"), F.asc("value")], k).select(
            "column_name", "value", "count", "rank")
    return by_head.select("column_name", F.col("head").alias("value"), "count", "rank")


def profile_columns(df: DataFrame, columns: list[str] | None = None,
                    counts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row per column: type tag, missing share, distinct count, moments, warnings.

    Pass ``counts`` (from ``value_counts``) or ``sizes`` (from ``count_sizes``) to share one value-count
    shuffle with top values or the advisor.
    """
    stats = column_stats(df, columns)
    uniq = profile_unique(df, columns, counts=counts, sizes=sizes)
    n = F.col("n_rows")
    nn = F.col("n_nonnull")
    inferred = (F.when(F.col("kind") == "boolean", "boolean")
                .when(F.col("kind") == "numeric", "numeric")
                .when(F.col("kind") == "datetime", "datetime")
                .when((F.col("kind") == "string") & (nn > 0) & (F.col("n_date") == nn), "datetime")
                .when((F.col("kind") == "string") & (F.col("avg_len") > TEXT_AVG_LEN), "text")
                .otherwise("categorical"))
    base = stats.join(F.broadcast(uniq), "column_name", "left").select(
        "column_name", "position", "dtype", inferred.alias("inferred_type"), "n_rows",
        (n - nn).alias("n_missing"),
        F.when(n > 0, (n - nn) / n).otherwise(F.lit(0.0)).alias("missing_pct"),
        F.coalesce(F.col("unique_count"), F.lit(0)).cast("long").alias("unique_count"),
        finite_or_null(F.col("mean")).alias("mean"),
        finite_or_null(F.col("std")).alias("std"),
        finite_or_null(F.col("min")).alias("min"),
        finite_or_null(F.col("max")).alias("max"),
        finite_or_null(F.when(F.col("std") > 0, sample_skewness(F.col("skew_pop"), nn.cast("double")))
                       .when((F.col("std") == 0) & (nn >= 3), F.lit(0.0))).alias("skewness"),
        finite_or_null(F.when(F.col("std") > 0, sample_kurtosis(F.col("kurt_pop"), nn.cast("double")))
                       .when((F.col("std") == 0) & (nn >= 4), F.lit(0.0))).alias("kurtosis"),
        F.when(inferred == "datetime", F.col("dt_min")).alias("dt_min"),
        F.when(inferred == "datetime", F.col("dt_max")).alias("dt_max"),
    )
    warnings = F.filter(F.array(
        F.when(F.col("missing_pct") > HIGH_MISSING, F.lit(WARN_MISSING)),
        F.when((F.col("inferred_type") == "numeric") & (F.col("std") < NEAR_ZERO_STD)
               & (F.col("unique_count") > 1), F.lit(WARN_LOW_VAR)),
        F.when((F.col("n_rows") > 0) & (F.col("unique_count") / F.col("n_rows") > HIGH_CARDINALITY)
               & (F.col("inferred_type") != "numeric"), F.lit(WARN_HIGH_CARD)),
    ), lambda x: x.isNotNull())
    return base.withColumn("warnings", warnings)


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows, missing cells and share, memory estimate.

    Duplicates are rows whose 128-bit hash over all columns (arrays, maps and structs included)
    was seen before; the group-by on the hash is map-side combined, so a row repeated a billion
    times costs one hash entry per task, and whole rows are never shuffled.
    """
    df = nan_to_null(df)
    cols = df.columns
    fields = df.schema.fields
    missing = sum((F.col(q(c)).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    size = F.lit(128).cast("long")
    for f in fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(F.col(q(f.name))), F.lit(0)) + F.lit(49)
        else:
            size = size + F.lit(8)
    # nested values as JSON text with their nulls; which columns are null is hashed too, as the
    # hash functions pass over nulls
    values = [F.col(q(f.name)) if is_scalar(f.dataType)
              else F.to_json(F.struct(F.col(q(f.name)).alias("v")), {"ignoreNullFields": "false"}) for f in fields]
    values.append(F.concat(*[F.col(q(c)).isNull().cast("int").cast("string") for c in cols]) if cols else F.lit(""))
    groups = df.groupBy(F.xxhash64(*values).alias("__h1"), F.xxhash64(F.lit(1), *values).alias("__h2")).agg(
        F.count(F.lit(1)).alias("__c"), F.sum(missing).alias("__m"), F.sum(size).alias("__b"))
    totals = groups.agg(
        F.sum("__c").alias("row_count"), F.sum(F.col("__c") - 1).alias("duplicate_rows"),
        F.sum("__m").alias("missing_cells"), F.sum("__b").alias("bytes"))
    ncol = len(cols)
    rc = F.coalesce(F.col("row_count"), F.lit(0)).cast("long")
    return totals.select(
        rc.alias("row_count"), F.lit(ncol).cast("long").alias("col_count"),
        F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long").alias("missing_cells"),
        F.when(rc * ncol > 0, F.col("missing_cells") / (rc * ncol))
         .otherwise(F.lit(0.0)).alias("missing_pct"),
        (F.coalesce(F.col("bytes"), F.lit(0)) / 1048576.0).alias("memory_mb"))


def profile_missing(df: DataFrame) -> DataFrame:
    return profile_columns(df).select("column_name", "n_missing", "missing_pct")


def profile_histogram(df: DataFrame, bins: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Equal-width histogram per numeric column; the last bin is closed.

    min/max come from a one-row aggregate joined back by broadcast; a constant
    column gets numpy's unit range around its value.
    """
    df = nan_to_null(df)
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)
           and (columns is None or f.name in columns)]
    spark = df.sparkSession
    if not num:
        return spark.createDataFrame([], "column_name string, bin long, lo double, hi double, count long")
    long = df.select(*[F.col(q(c)).cast("double").alias(c) for c in num]).unpivot(
        [], num, "column_name", "v").where(F.col("v").isNotNull())
    rng = long.groupBy("column_name").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    rng = rng.select("column_name",
                     F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5).alias("lo0"),
                     F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5).alias("hi0"))
    b = F.least(F.floor((F.col("v") - F.col("lo0")) * F.lit(float(bins)) / (F.col("hi0") - F.col("lo0")))
                .cast("long"), F.lit(bins - 1))
    counted = (long.join(F.broadcast(rng), "column_name").withColumn("bin", b)
               .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = (F.col("hi0") - F.col("lo0")) / F.lit(float(bins))
    return (grid.join(counted, ["column_name", "bin"], "left")
            .select("column_name", "bin",
                    (F.col("lo0") + F.col("bin") * width).alias("lo"),
                    (F.col("lo0") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def profile_quantiles(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75),
                      approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """(column, p, value): linear-interpolated quantiles (pandas `quantile`).

    Exact by default, in a plan that holds no column in one buffer; ``approx=True`` uses
    ``percentile_approx``.
    """
    df = nan_to_null(df)
    spark = df.sparkSession
    if approx:
        wide = df.agg(*[F.percentile_approx(F.col(q(c)).cast("double"), list(probs), accuracy).alias(f"q{i}")
                        for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("p"),
                         F.col(f"q{i}")[j].cast("double").alias("value"))
                for i, c in enumerate(columns) for j, p in enumerate(probs)]
        return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    from ..functions.quantiles import quantiles_long
    long = df.select(*[F.col(q(c)).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    return quantiles_long(long, ["column_name"], "v", list(probs))


def profile_datetime_range(df: DataFrame) -> DataFrame:
    return (profile_columns(df).where(F.col("inferred_type") == "datetime")
            .select("column_name", "dt_min", "dt_max"))
