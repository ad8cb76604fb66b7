"""Helpers the training-data operators share: tables, scratch tables, numbering, skew-safe lookups.

Nothing here collects rows that grow with the corpus.  Intermediate tables are Parquet files below
the folder the cluster names in ``spark.checkpoint.dir`` (shared by driver and executors), so a
lost executor never takes the only copy of a result with it.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread

HOT_SHARE = 1000  # a key is hot when it holds at least 1/HOT_SHARE of the rows: at most HOT_SHARE keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a single-split file is spread over the cores first."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_key(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def numbered(df: DataFrame, group: str, order: list[str], out: str, blocks: int = 256,
             chunk: int = 65536) -> DataFrame:
    """Number the rows of every ``group`` gaplessly from 0 in column ``out``, the same way every run.

    No group is ever sorted in one task.  Equal rows are counted first and cut into chunks, chunks
    are dealt over ``blocks`` by an md5 of the order columns, running counts are taken inside a
    block and shifted by the rows of the blocks before.  Equal rows differ only by their number, so
    the result is a function of the input rows alone.  The offset table has at most
    (groups x blocks) rows.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    parts = (counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
             .withColumn("_n", F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_from"))))
    deal = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order], F.col("_from").cast("string")).cast("binary"))
    block = F.conv(F.substring(deal, 1, 4), 16, 10).cast("int") % F.lit(blocks)
    dealt = saved(parts.withColumn("_block", block), "dealt")
    sizes = dealt.groupBy(group, "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy(group, "_block").orderBy(*order, "_from")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.withColumn("_rank", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .join(offsets, [group, "_block"])
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
            .withColumn(out, (F.col("_offset") + F.col("_rank") + F.col("_copy")).cast("long"))
            .drop("_block", "_rank", "_offset", "_copy", "_from", "_n"))


def hot_split(counted: DataFrame, count: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Split a per-key table into its hot keys and the rest.

    Hot keys hold at least 1/HOT_SHARE of ``total`` rows each, so there are at most HOT_SHARE of
    them whatever the size of the input: that part may be broadcast.
    """
    hot = F.col(count) * HOT_SHARE >= F.lit(max(total, 1))
    return counted.filter(hot), counted.filter(~hot)


def lookup(df: DataFrame, key: str, counted: DataFrame, value: str, count: str, total: int,
           salt: list[str]) -> DataFrame:
    """Left lookup of ``value`` by ``key`` in a per-key table, safe when few keys hold most rows.

    Hot keys (see ``hot_split``) come from a broadcast of at most HOT_SHARE rows.  All other rows
    join by a shuffle; rows already answered, and null keys, are dealt by a hash of the ``salt``
    columns that matches nothing (a function of the row, so a repeated task deals it the same way).
    Key must be a string column.  Adds ``value``, null where the key is not listed.
    """
    hot, rest = hot_split(counted.select(key, value, count), count, total)
    hot = F.broadcast(hot.select(F.col(key).alias("_hk"), F.col(value).alias("_hv"), F.lit(True).alias("_hit")))
    first = df.join(hot, F.col(key) == F.col("_hk"), "left")
    salted = F.concat(F.lit("\u0000"), F.xxhash64(*salt).cast("string"))
    first = first.withColumn("_k2", F.when(F.col("_hit").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(salted))
    rest = rest.select(F.col(key).alias("_rk"), F.col(value).alias("_rv"))
    return (first.join(rest, F.col("_k2") == F.col("_rk"), "left")
            .withColumn(value, F.when(F.col("_hit"), F.col("_hv")).otherwise(F.col("_rv")))
            .drop("_hk", "_hv", "_hit", "_k2", "_rk", "_rv"))
