"""SimHash near-duplicates from a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes.  Fingerprints that differ in at most d bits share at least
8 - d of them (the guaranteed minimum).  Lists of single bytes would hold 1/256 of all fingerprints
each, so the index is keyed by every choice of 8 - d positions with their bytes: a pair that shares
that many bytes meets in a list.  For a pair that meets, the shared positional bytes are tallied,
pairs below the minimum are dropped, a pair is kept only in the first list it shares, and the
differing bits are counted.

Equal fingerprints are one node before the search.  Nothing is capped: lists are joined by Spark,
whose adaptive join splits long ones.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; fewer words than
a shingle are one shingle; a null id never names a component (the component id is null where all
ids are); repeated rows are linked as equal fingerprints; an empty table gives an empty result;
columns besides id and text are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, saved, table, unused
from .components import components

SHINGLE = 4      # words
MAX_BITS = 4     # differing bits of a link
SEED = 42
BYTES = 8
STEP = 1 << 18   # shingles tallied at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, STEP):
        spans = zip(starts[i:min(n, i + STEP)].tolist(), ends[i:i + STEP].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; the text column is dropped."""
    kept = [c for c in docs.columns if c not in (text_col, out)]
    source = docs.select(*kept, F.col(text_col).cast("string").cast("binary").alias(unused(docs, "_body")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"", shingle) for v in batch.column(len(kept))]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], column], [*kept, out])

    return source.mapInArrow(add, T.StructType(source.schema.fields[:-1]).add(out, "long"))


def linked(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Every pair ``a`` < ``b`` of distinct fingerprints in column ``fp`` that differ in at most ``max_bits`` bits."""
    least = BYTES - max_bits
    if not 0 < least <= BYTES:
        raise ValueError("between 0 and 7 bits may differ")
    choices = list(combinations(range(BYTES), least))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(0xFF << 8 * p for p in c)) for c in choices]
    lists = nodes.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    a = lists.select(F.col("fp").alias("a"), F.col("mask").alias("mask_a"))
    b = lists.select(F.col("fp").alias("b"), F.col("mask").alias("mask_b"))
    meet = (F.col("mask_a") == F.col("mask_b")) & (F.col("a").bitwiseAND(F.col("mask_a")) == F.col("b").bitwiseAND(F.col("mask_b")))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.when(differ.bitwiseAND(F.lit(signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(BYTES)]
    tally = sum(same[1:], same[0])
    # the pair belongs to the list of its first shared positions: no shared position below the
    # list's last one may be outside the list
    before = F.lit(True)
    for p in range(BYTES):
        later = F.col("mask_a").bitwiseAND(F.lit(signed(sum(0xFF << 8 * q for q in range(p + 1, BYTES))))) != 0
        outside = F.col("mask_a").bitwiseAND(F.lit(signed(0xFF << 8 * p))) == 0
        before = before & ~(later & outside & (same[p] == 1))
    near = (F.col("a") < F.col("b")) & (tally >= least) & (F.bit_count(differ) <= max_bits) & before
    # Spark's size estimate does not see that the lists are many times the fingerprints: no broadcast
    return a.hint("merge").join(b.hint("merge"), meet & near).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: the id, further columns given, ``fp`` (signed long), ``component_id`` and ``root``.

    ``component_id`` is the smallest id reachable by links, the row's own included; ``root`` is a
    fingerprint that all rows of the component share.
    """
    marked = saved(fingerprints(docs, text_col, "fp", shingle), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(saved(linked(nodes, max_bits), "pairs"))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    ids = saved(rooted.select("fp", "n", "root", "first"), "rooted")
    least = saved(ids.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = saved(ids.join(least, "root").select(F.col("fp").cast("string").alias("key"), F.struct("component_id", "root").alias("cls"), "n"), "named")
    total = marked.count()
    found = lookup(marked.withColumn("key", F.col("fp").cast("string")), "key", named, "cls", "n", total, [id_col, "fp"])
    return found.withColumns({"component_id": F.col("cls.component_id"), "root": F.col("cls.root")}).drop("key", "cls")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id, null ids last, ties by content."""
    names = docs.columns
    columns = [f"_c{i}" for i in range(len(names))]  # whatever they are called
    docs, id_col, text_col = docs.toDF(*columns), columns[names.index(id_col)], columns[names.index(text_col)]
    key = F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit(SEED), *columns).alias("y"))
    found = classes(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), key.alias("_row")), "_id", "text", shingle, max_bits)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_row"))).alias("m"))
    keep = best.select(F.col("m._row.x").alias("_x"), F.col("m._row.y").alias("_y"))
    single = docs.withColumns({"_x": F.xxhash64(*columns), "_y": F.xxhash64(F.lit(SEED), *columns)}).dropDuplicates(["_x", "_y"])
    return single.join(keep, ["_x", "_y"], "left_semi").select(*columns).toDF(*names)


def op6_simhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
