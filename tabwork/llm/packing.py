"""Packing by power-of-two decomposition.

A document of n ids becomes pieces whose lengths are the powers of two of n: as many of the largest
length as fit, then the binary digits of the rest.  Pieces of equal length form one bucket, each
piece is a sequence of its own, so no sequence crosses documents and none is padded.

Everything about a document is decided in its own row: no shuffle.  Sequence ids are the row ids of
the scan, unique over the table.

Defined cases: a null text is empty and packs as the end id alone; special-token strings in a text
are handled as the tokenizer handles them; repeated rows are packed once each; an empty table gives
an empty result; other columns of the documents are not read.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SEQUENCE = 2048   # longest sequence, a power of two
END_ID = 1        # id that ends every document
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
# How byte-level tokenizers cut a text into words: a fixed value
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def piece_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length(), -1, -1) if rest >> b & 1]


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, inverted.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Ids:
    """Ids of a text as little-endian 32-bit bytes, from a tokenizer file of the byte-level BPE kind.

    The merges of such a file are ranked by the ids they make, so its vocabulary is a table of byte
    strings by rank, which tiktoken encodes with about five times the speed of the file's own
    library.  A file of any other kind is encoded by that library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special, self.fast = list(special), None
        if self._ranked(file):
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _ranked(file: dict) -> bool:
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex")
                 and not cut.get("add_prefix_space") and file["normalizer"] is None and not model.get("ignore_merges")
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]))
        if not plain:
            return False
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return all(a < b for a, b in zip(made, made[1:]))

    def of(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(s in text for s in self.special):
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _splitter(path: str, longest: int, end_id: int):
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    end = int(end_id).to_bytes(4, "little")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = ids.of(text.as_py() or "") + end
                n, start = len(whole) // 4, 0
                for length in piece_lengths(n, longest):
                    rows.append((doc_id.as_py(), start, length, n, whole[4 * start:4 * (start + length)]))
                    start += length
                held += len(whole)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return split


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket.

    ``ids`` holds little-endian unsigned 32-bit ids; ``bucket`` is the binary logarithm of the
    length.  ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = source.mapInArrow(_splitter(tokenizer, longest, end_id), PIECES)
    return (pieces.withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", F.log2(F.col("length")).cast("int")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences as a table partitioned by bucket: a batch of one bucket has one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The sequences without their ids, with a checksum of them."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_power_packing(spark, sf_dir):
    return digest(sequences(table(spark, sf_dir, "documents"), default_tokenizer()))
