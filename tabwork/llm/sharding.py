"""Sharding by jump consistent hashing, in SQL functions only.

A stable 64-bit key walks the jump sequence of Lamping and Veach: a 64-bit linear congruential
generator draws, and the walk jumps from bucket to bucket until it would leave the range.  There is
no ring table; appending a shard moves only the rows that land in the new one.

Defined cases: a null id counts as the empty id text; a null text has no bytes and crc32 0; equal
rows go to the same shard (the id decides) and take different slots; an empty table gives an empty
result; columns that clash with the result's names are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved, table, text_of

MULTIPLIER = 2862933555777941757  # fixed value of the published generator
SHARDS = 16


def stable_key(column: str) -> Column:
    """The first 64 bits of the md5 of the id text, as DECIMAL(20,0)."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def _next_key(key: str) -> str:
    """SQL of the generator's next state, modulo 2^64.

    Halves of 32 bits keep every product inside DECIMAL(38,0), so nothing overflows under ANSI mode.
    """
    low = f"CAST({key} % 4294967296 AS DECIMAL(10,0))"
    high = f"CAST({key} div 4294967296 AS DECIMAL(10,0))"
    return (f"CAST(({low} * CAST({MULTIPLIER} AS DECIMAL(19,0)) "
            f"+ (({high} * CAST({MULTIPLIER % 2**32} AS DECIMAL(10,0))) % 4294967296) * CAST(4294967296 AS DECIMAL(10,0)) "
            f"+ 1) % CAST(18446744073709551616 AS DECIMAL(20,0)) AS DECIMAL(20,0))")


def jump_shard(key: str, shards: int) -> Column:
    """Shard 0..shards-1 of the DECIMAL(20,0) column ``key``.

    The walk takes at most ``shards`` steps (a logarithm of them on average); steps after its end
    leave the state as it is.
    """
    step = (f"transform(array({_next_key('s.k')}), k -> named_struct('b', s.j, 'j', "
            "CAST(floor((s.j + 1) * (2147483648D / ((k div 8589934592) + 1))) AS BIGINT), 'k', k))[0]")
    return F.expr(f"CAST(aggregate(sequence(1, {int(shards)}), "
                  f"named_struct('b', -1L, 'j', 0L, 'k', {key}), "
                  f"(s, i) -> CASE WHEN s.j >= {int(shards)} THEN s ELSE {step} END, s -> s.b) AS INT)")


def assign(df: DataFrame, id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (of ``shards``) and ``grown_shard`` (of one more) to every row."""
    return (df.withColumn("_key", stable_key(id_col))
            .withColumn("shard", jump_shard("_key", shards))
            .withColumn("grown_shard", jump_shard("_key", shards + 1)).drop("_key"))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot in the shard, grown_shard.

    The text is read once for its size and checksum and moves nowhere; only the narrow rows are
    shuffled to number the slots.
    """
    body = text_of(text_col).cast("binary")
    narrow = docs.select(F.col(id_col), (F.octet_length(body) + 1).cast("long").alias("size"),
                         F.crc32(body).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    placed = numbered(saved(assign(narrow, id_col, shards), "placed"), "shard", [id_col, "text_crc32", "size"], "slot")
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS) -> None:
    """Write the whole rows as a table partitioned by shard; large shards become several files."""
    assign(docs, id_col, shards).write.partitionBy("shard").parquet(path)


def op8_jump_sharding(spark, sf_dir):
    return placements(table(spark, sf_dir, "documents"))
