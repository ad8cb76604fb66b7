"""Column-expression helpers shared by the operators (all JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_scalar(dt: T.DataType) -> bool:
    """Columns that can be counted by value (no arrays, maps, structs, vectors)."""
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType,
                               T.UserDefinedType))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """`select_dtypes(number)`: numeric, non-boolean columns in schema order."""
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null both count as missing; normalise NaN to null on entry."""
    sel = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            sel.append(F.when(F.isnan(F.col(q(f.name))), F.lit(None))
                       .otherwise(F.col(q(f.name))).cast(f.dataType).alias(f.name))
            changed = True
        else:
            sel.append(F.col(q(f.name)))
    return df.select(*sel) if changed else df


def is_missing(c: str, dt: T.DataType) -> Column:
    col = F.col(q(c))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def finite_or_null(c: Column) -> Column:
    """±inf and NaN are reported as null (profiler `_safe`)."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sample_skewness(g: Column, n: Column) -> Column:
    """Spark's population skewness -> bias-corrected G1 (pandas `skew`)."""
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(k: Column, n: Column) -> Column:
    """Spark's population excess kurtosis -> bias-corrected G2 (pandas `kurt`)."""
    return F.when(n >= 4, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3)))


def mask_text(c: Column) -> Column:
    """`ab***yz` masking; values of at most 4 characters become `***`."""
    s = c.cast("string")
    n = F.length(s)
    return (F.when(s.isNull(), F.lit(None))
            .when(n <= 4, F.lit("***"))
            .otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 4),
                                F.substring(s, -2, 2))))


def hash_unit(*cols: Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random number in [0, 1) from row content.

    Unlike `rand(seed)` it does not depend on partitioning, so samples,
    folds and splits are the same after a repartition or a retried task.
    """
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1_000_000_007)).cast("double") / F.lit(1_000_000_007.0)


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)] or [[]]


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan (no job is run)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - statistics unavailable
        return 0


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict:
    """{(column, p): value}, exact at every size: one plan, no column in a single buffer."""
    from .quantiles import exact_quantiles
    return exact_quantiles(df, columns, probs)
