"""Benchmark decontamination with suffix arrays over the training documents.

A task takes its documents as shards of words, numbers the words by the benchmark's vocabulary and
sorts the suffixes of the shard by their first ``window`` words.  Only suffixes that could match are
sorted: those whose word pairs all occur in the benchmark.  Every benchmark suffix is then found by
binary search; the range gives all its occurrences, which are extended to the longest verbatim
match.  A document lies in one shard, so nothing about documents is shuffled.

The benchmark is sent to the tasks in blocks of bounded bytes (BLOCK_BYTES); a larger benchmark
becomes more blocks that each task goes through one after the other.

Defined cases: words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a null
or wordless text has no words, no hits and is clean; an item without words is ignored, one of fewer
words than the window is a single shorter window; items of equal id count once and a null item id is
written as empty text; repeated documents are judged row by row; an empty benchmark leaves all
documents; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

WINDOW = 10                # words of a verbatim match that counts
BLOCK_BYTES = 32 << 20     # benchmark text sent to the tasks at a time
SHARD_WORDS = 1 << 20      # words of documents under one suffix array
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCH = "doc_id long, doc_start long, item_id string, item_start long, length long"
#: separators become spaces, A-Z become a-z
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


class TestIndex:
    """The windows of one block of benchmark items, sorted, with the items they come from."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocab = window, {}
        vocab = self.vocab
        texts = [(name, [vocab.setdefault(w, len(vocab) + 1) for w in words_of(data)]) for name, data in items]
        texts = [(name, np.array(ids, np.int64)) for name, ids in texts if ids]
        self.names = sorted({name for name, _ in texts})
        place = {name: i for i, name in enumerate(self.names)}
        self.bits = max(1, (len(vocab) + 1).bit_length())
        self.per = max(1, 63 // self.bits)
        self.depth = -(-window // self.per)
        starts, owners, offsets, lengths, at = [], [], [], [], 0
        self.owner_of = [place[name] for name, _ in texts]
        self.text = np.concatenate([np.concatenate([ids, [0]]) for _, ids in texts] + [np.zeros(window, np.int64)])
        for k, (_, ids) in enumerate(texts):
            n = max(1, len(ids) - window + 1)
            starts.append(np.arange(at, at + n))
            owners.append(np.full(n, k))
            offsets.append(np.arange(n))
            lengths.append(np.full(n, min(window, len(ids))))
            at += len(ids) + 1
        if not texts:
            self.lengths = np.zeros(0, np.int64)
            return
        start, owner, offset, length = (np.concatenate(x) for x in (starts, owners, offsets, lengths))
        keys = self.keys(self.text, start, length)
        order = np.lexsort([length, *keys.T[::-1]])
        keys, start, owner, offset, length = keys[order], start[order], owner[order], offset[order], length[order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (length[1:] != length[:-1])
        first = np.flatnonzero(new)
        #: distinct windows; those of window i come from rows[i]:rows[i + 1] of the sorted suffixes
        self.low, self.lengths, self.rows = keys[first], length[first], np.append(first, len(order))
        self.suffix, self.owner, self.offset = start, np.array(self.owner_of)[owner], offset
        self.high = self.low + self._beyond(self.lengths)
        inside = self.text[:-1] * self.text[1:] > 0
        self.pairs = np.unique((self.text[:-1] << 32 | self.text[1:])[inside])
        self.shortest = int(self.lengths.min())

    def keys(self, text: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The first ``length`` words at each place, packed into ``depth`` integers that sort alike."""
        out = np.zeros((len(at), self.depth), np.int64)
        for j in range(self.window):
            word = np.where(j < length, text[np.minimum(at + j, len(text) - 1)], 0)
            out[:, j // self.per] |= word << (self.bits * (self.per - 1 - j % self.per))
        return out

    def _beyond(self, length: np.ndarray) -> np.ndarray:
        """What makes a window's key the largest key that begins with the window."""
        out = np.zeros((len(length), self.depth), np.int64)
        for j in range(self.window):
            fill = np.where(j >= length, (1 << self.bits) - 1, 0)
            out[:, j // self.per] += fill << (self.bits * (self.per - 1 - j % self.per))
        return out

    def suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes that could match, sorted by their first words, and their keys."""
        run = np.zeros(len(text), np.int32)
        known = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
        pair = text[known] << 32 | text[known + 1]
        spot = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        linked = np.zeros(len(text), bool)
        if len(self.pairs):
            linked[known] = self.pairs[spot] == pair
        # run: words from here on whose pairs are all known
        breaks = np.flatnonzero(~linked)
        run = breaks[np.searchsorted(breaks, np.arange(len(text)))] - np.arange(len(text)) + (text > 0)
        at = np.flatnonzero((text > 0) & (run >= self.shortest))
        keys = self.keys(text, at, self.window)
        order = np.lexsort(keys.T[::-1])
        return at[order], keys[order]

    @staticmethod
    def _search(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of every wanted key at once: rows before it, or up to it."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(keys) - 1)
            before, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for k in range(keys.shape[1]):
                found = keys[middle, k]
                before |= equal & (found < wanted[:, k])
                equal &= found == wanted[:, k]
            up = before | (equal if right else False)
            low, high = np.where(open_ & up, middle + 1, low), np.where(open_ & ~up, middle, high)
        return low

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the distinct window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or len(text) < 2:
            return none, none
        at, keys = self.suffix_array(text)
        if not len(at):
            return none, none
        first, last = self._search(keys, self.low, False), self._search(keys, self.high, True)
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return at[rows], window

    def spread(self, windows: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every window replaced by the suffixes it comes from; ``others`` are repeated alongside."""
        n = self.rows[windows + 1] - self.rows[windows]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.rows[windows], n)
        return (rows, *[np.repeat(x, n) for x in others])


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of about ``block_bytes`` of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
                             F.col(text_col).cast("string").cast("binary").alias("data")).filter("data is not null")
    total = items.agg(F.sum(F.octet_length("data") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = []
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("name", "data"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = [(r.name, bytes(r.data)) for r in part.distinct().toLocalIterator()]
        out.append(spark.sparkContext.broadcast(TestIndex(sorted(rows), window)))
    return out


test_blocks.__test__ = False


class _Shard:
    """Some documents: their words, and what the benchmark blocks found in them."""

    def __init__(self):
        self.words, self.sizes, self.rows = [], [], []

    def add(self, data: bytes, row) -> None:
        found = words_of(data)
        self.words += found
        self.words.append(b" ")  # no word: windows do not cross documents
        self.sizes.append(len(found))
        self.rows.append(row)

    def numbers(self, vocab: dict) -> np.ndarray:
        return np.fromiter(map(vocab.get, self.words, repeat(0)), np.int64, len(self.words))

    def starts(self) -> np.ndarray:
        return np.cumsum([0] + [n + 1 for n in self.sizes])

    def judge(self, blocks) -> list[tuple]:
        starts = self.starts()
        hit, items = np.zeros(len(self.words) + 1, bool), [set() for _ in self.sizes]
        for block in blocks:
            index = block.value
            at, window = index.occurrences(self.numbers(index.vocab))
            if not len(at):
                continue
            edge = np.zeros(len(self.words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + index.lengths[window], -1)
            hit |= np.cumsum(edge) > 0
            doc = np.searchsorted(starts, at, "right") - 1
            pair = np.unique(doc << 32 | window)
            rows, doc = index.spread(pair & 0xFFFFFFFF, pair >> 32)
            for key in np.unique(doc << 32 | index.owner[rows]).tolist():
                items[key >> 32].add(index.names[key & 0xFFFFFFFF])
        counts = np.add.reduceat(hit[:-1].astype(np.int64), starts[:-1])
        return [(n, h, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), h > 0)
                for n, h, names in zip(self.sizes, counts.tolist(), items, strict=True)]

    def matches(self, blocks) -> list[tuple]:
        starts, out = self.starts(), []
        for block in blocks:
            index = block.value
            text = np.append(self.numbers(index.vocab), 0)
            at, window = index.occurrences(text)
            rows, at = index.spread(window, at)
            suffix = index.suffix[rows]
            # what a match further left contains is not reported again
            left = (suffix > 0) & (at > 0) & (index.text[suffix - 1] == text[at - 1]) & (text[at - 1] > 0)
            rows, at, suffix = rows[~left], at[~left], suffix[~left]
            length = np.zeros(len(at), np.int64)
            going = np.arange(len(at))
            while len(going):  # word by word to the longest verbatim match
                a, b = at[going] + length[going], suffix[going] + length[going]
                same = (text[np.minimum(a, len(text) - 1)] == index.text[b]) & (index.text[b] > 0)
                going = going[same]
                length[going] += 1
            doc = np.searchsorted(starts, at, "right") - 1
            out += [(self.rows[d], int(a - starts[d]), index.names[o], int(f), int(n))
                    for d, a, o, f, n in zip(doc.tolist(), at.tolist(), index.owner[rows].tolist(),
                                             index.offset[rows].tolist(), length.tolist(), strict=True)]
        return out


def _shards(batch: pa.RecordBatch, text: int, shard_words: int) -> Iterator[_Shard]:
    shard = _Shard()
    for i, value in enumerate(batch.column(text)):
        shard.add(value.as_buffer().to_pybytes() if value.is_valid else b"", i)
        if len(shard.words) >= shard_words:
            yield shard
            shard = _Shard()
    if shard.rows:
        yield shard


def judged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
           shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated; columns of these names are replaced."""
    blocks = test_blocks(benchmark, item_id, item_text, window, block_bytes)
    added = [c.split() for c in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kept = docs.drop(*[n for n, _ in added])
    kept = kept.select(*kept.columns, F.col(text_col).cast("string").cast("binary").alias(unused(kept, "_body")))
    last = len(kept.columns) - 1

    def judge(batches):
        for batch in batches:
            rows = [r for shard in _shards(batch, last, shard_words) for r in shard.judge(blocks)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in added]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], *[pa.array(c, kinds[k]) for c, (_, k) in zip(columns, added, strict=True)]],
                [*batch.schema.names[:last], *[n for n, _ in added]])

    schema = T.StructType(kept.schema.fields[:-1])
    for name, kind in added:
        schema = schema.add(name, kind)
    return kept.mapInArrow(judge, schema)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim matches with their places, counted in words: one row per maximal match."""
    blocks = test_blocks(benchmark, item_id, item_text, window, block_bytes)
    names = [c.split()[0] for c in MATCH.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], *rest) for shard in _shards(batch, 1, shard_words) for r, *rest in shard.matches(blocks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return source.mapInArrow(find, MATCH)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark window; the columns stay as they are."""
    marked = docs.withColumn("_row", F.struct(*[F.col(c) for c in docs.columns]))
    clean = judged(marked.select("_row", F.col(options.pop("text_col", "text")).alias("text")), benchmark, **options)
    return clean.filter(~F.col("contaminated")).select("_row.*")


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text")


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, n, win FROM dw WHERE win IN (SELECT win FROM g)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits JOIN g USING (n, win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN names USING (doc_id)
"""
