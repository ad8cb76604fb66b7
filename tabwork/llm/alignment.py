"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizations of a text cover the same bytes: the text with one space before it.  A batch of
documents becomes two frames of token starts, keyed by document; ``pandas.merge_asof`` finds for each
token start the token of the other side that covers it, in both directions.  The union of both
directions is every pair of overlapping tokens.  Overlapping tokens that end at the same byte end a
group; tokens of a group are linked with each other.

A group may be as long as a text, so pairs of token occurrences are never written out: tokens of a
group are counted by id first, and links are pairs of ids with a multiplicity.  ``aligned`` gives one
row per document with these; how many documents hold a pair is counted by Spark from the rows' distinct
pairs, and set against each document by ``counted``: by a broadcast of the sorted pairs while there are
at most PAIRS of them (12 bytes each), else by a join on the pair.  Both give the same rows.

Defined cases: a text that is null or empty, or whose tokens of either side do not spell the space and
the text, has no tokens: zeros and the empty string; strings of special tokens are plain text; a text
longer than CHUNK is encoded in parts for the side whose vocabulary holds no token across the cuts, whole
otherwise; ids that repeat or are null give a row each, and each row counts as a document; an empty
table gives an empty result; columns but id and text are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .packing import _byte_of, _Ids

PART = 1 << 20        # bytes of text aligned at once
CHUNK = 1 << 20       # characters of one text encoded at once by a side that can be cut
PAIRS = 4_000_000     # pairs of ids that may be broadcast
EXPANDED = 1 << 22    # pairs of ids written out at once
PER_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class _ByteLevel:
    """Ids and their bytes of a byte-level tokenizer file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        ids = _Ids(path)
        self.fast, self.tokenizer = ids.fast, ids.tokenizer
        self.tokenizer.encode_special_tokens = True
        byte_of, size = _byte_of(), self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return np.array(self.fast.encode_ordinary(" " + text), np.int64)
        return np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64)


class _Pieces:
    """Ids and their bytes of a sentencepiece model that adds a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode()
                      for i, t in enumerate(names)]
        # no piece continues over a space: merges on its two sides are independent
        self.cuts = not any(" " in t.replace("▁", " ").lstrip(" ") for t in names)

    def of(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while self.cuts and len(text) - at > CHUNK:
            end = text.find(" ", at + CHUNK)
            while end > 0 and text[end - 1] in " ▁":  # a run of spaces is not cut
                end = text.find(" ", end + 1)
            if end < 0 or end + 1 == len(text):
                break
            parts.append(text[at:end])
            at = end + 1  # the model adds this space again
        return np.concatenate([np.array(self.model.encode(p), np.int64) for p in [*parts, text[at:]]])


class _Sides:
    """Both tokenizers, their tokens' bytes, and their ids as text followed by each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _ByteLevel(path_a), _Pieces(path_b)

    @cached_property
    def tables(self) -> list:
        out = []
        for side, last in ((self.a, "|"), (self.b, ";")):
            spelled = np.empty(len(side.bytes), object)
            spelled[:] = side.bytes
            n = len(spelled)
            named = np.array([f"{i}{s}" for s in (",", last) for i in range(n)], object)
            out.append((np.array([len(t) for t in side.bytes], np.int64), spelled, named))
        return out

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where either does not spell the space and the text."""
        if not text:
            return None
        whole, found = b" " + text.encode(), []
        for side, (length, spelled, _) in zip((self.a, self.b), self.tables, strict=True):
            ids = side.of(text)
            if int(length[ids].sum()) != len(whole) or not length[ids].all() or b"".join(spelled[ids].tolist()) != whole:
                return None
            found.append(ids)
        return found[0], found[1]


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of every overlapping pair of tokens, from frames (doc, start) that cover the same bytes.

    ``start`` counts from the beginning of the batch, so it is in order over all documents.
    """
    at_a, at_b = np.arange(len(a)), np.arange(len(b))
    if not len(a):
        return at_a, at_b
    covers_a = pd.merge_asof(a, b.assign(other=at_b), on="start", by="doc")["other"].to_numpy()
    covers_b = pd.merge_asof(b, a.assign(other=at_a), on="start", by="doc")["other"].to_numpy()
    # a pair that starts together is found from both sides: taken once
    later = b["start"].to_numpy() != a["start"].to_numpy()[covers_b]
    return np.concatenate([at_a, covers_b[later]]), np.concatenate([covers_a, at_b[later]])


class _Aligned:
    """Tokens, groups and links of a batch of documents."""

    def __init__(self, sides: _Sides, texts: list[str | None]):
        (len_a, _, self.name_a), (len_b, _, self.name_b) = sides.tables
        each = [sides.tokens(t) for t in texts]
        none = np.zeros(0, np.int64)
        pairs = [p or (none, none) for p in each]
        docs = np.arange(len(texts))
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([p[k] for p in pairs]) if pairs else none for k in (0, 1))
        self.doc_a, self.doc_b = np.repeat(docs, self.n_a), np.repeat(docs, self.n_b)
        size_a, size_b = len_a[self.a], len_b[self.b]
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.start_a, self.start_b = self.end_a - size_a, self.end_b - size_b
        self.pair_a, self.pair_b = overlapping(pd.DataFrame({"doc": self.doc_a, "start": self.start_a}),
                                               pd.DataFrame({"doc": self.doc_b, "start": self.start_b}))
        together = self.end_a[self.pair_a] == self.end_b[self.pair_b]
        self.last_a, self.last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.last_a[self.pair_a[together]] = True
        self.last_b[self.pair_b[together]] = True
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b
        self.n = len(texts)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each document."""
        doc = self.doc_a[self.last_a]
        links = np.bincount(self.group_a) * np.bincount(self.group_b) if len(self.a) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(links)])
        edge = np.searchsorted(doc, np.arange(self.n + 1))
        return np.diff(edge), sums[edge[1:]] - sums[edge[:-1]]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text."""
        before_b = np.concatenate([[0], np.cumsum(np.bincount(self.group_b))]) if len(self.b) else np.zeros(1, np.int64)
        upto_a = np.cumsum(np.bincount(self.group_a)) if len(self.a) else np.zeros(0, np.int64)
        words = np.empty(len(self.a) + len(self.b), object)
        words[np.arange(len(self.a)) + before_b[self.group_a]] = self.name_a[self.a + self.last_a * (len(self.name_a) // 2)]
        words[np.arange(len(self.b)) + upto_a[self.group_b]] = self.name_b[self.b + self.last_b * (len(self.name_b) // 2)]
        edge = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return [hashlib.sha256("".join(words[i:j].tolist())[:-1].encode()).hexdigest() if j > i else ""
                for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, links) of the distinct pairs of each document, pair = a * width + b, in order."""
        if not len(self.a):
            return (np.zeros(0, np.int64),) * 3
        group_doc = self.doc_a[self.last_a]
        (at_a, id_a, many_a), (at_b, id_b, many_b) = (_by_id(g, i) for g, i in ((self.group_a, self.a), (self.group_b, self.b)))
        first = np.searchsorted(at_b, np.arange(len(group_doc) + 1))
        reach = (first[1:] - first[:-1])[at_a]  # ids of the other side in the group
        parts = []
        edge = np.concatenate([[0], np.cumsum(reach)])
        i = 0
        while i < len(at_a):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + EXPANDED, "right")) - 1)
            one = np.repeat(np.arange(i, j), reach[i:j])
            two = np.arange(len(one)) - (edge[one] - edge[i]) + first[at_a[one]]
            doc, pair = group_doc[at_a[one]], id_a[one] * width + id_b[two]
            parts.append(_summed(doc, pair, many_a[one] * many_b[two]))
            i = j
        return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _by_id(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, occurrences), in order."""
    both, many = np.unique(group << 32 | ids, return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, many


def _summed(doc: np.ndarray, pair: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    span = int(pair.max()) + 1  # documents of a part times pairs of ids: far within 64 bits
    both = doc * span + pair
    order = np.argsort(both)
    both = both[order]
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[new] // span, both[new] % span, np.add.reduceat(many[order], new)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows whose texts together hold about PART bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART)))
            part = batch.slice(at, end - at)
            yield part, part.column(1).to_pylist()
            at = end


def _width(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string"))


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links.

    ``pairs`` lists the linked id pairs, A's id times the size of B's vocabulary plus B's id, in
    order, and ``links`` how often each is linked.
    """
    width = _width(path_b)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(path_a, path_b)
        for part, texts in _parts(batches):
            found = _Aligned(sides, texts)
            groups, links = found.counts()
            doc, pair, many = found.links(width)
            edge = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, groups, links)),
                 pa.array(found.digests(), pa.string()), pa.ListArray.from_arrays(edge, pa.array(pair, pa.int64())),
                 pa.ListArray.from_arrays(edge, pa.array(many, pa.int64()))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return _source(docs, id_col, text_col).mapInArrow(
        align, f"id {_id_type(docs, id_col)}, {PER_DOC}, pairs array<long>, links array<long>")


def overlaps(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of overlapping tokens: id, at_a, at_b (positions in the document), a, b (ids), from, to
    (bytes that both cover, the space before the text included), group (number in the document)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(path_a, path_b)
        for part, texts in _parts(batches):
            x = _Aligned(sides, texts)
            order = np.lexsort((x.pair_b, x.pair_a))
            i, j = x.pair_a[order], x.pair_b[order]
            doc = x.doc_a[i]
            first = lambda values, of: values[np.searchsorted(of, doc)]
            base = first(x.start_a, x.doc_a)
            columns = [i - np.searchsorted(x.doc_a, doc), j - np.searchsorted(x.doc_b, doc), x.a[i], x.b[j],
                       np.maximum(x.start_a[i], x.start_b[j]) - base, np.minimum(x.end_a[i], x.end_b[j]) - base,
                       x.group_a[i] - first(x.group_a, x.doc_a)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns)],
                                             ["id", "at_a", "at_b", "a", "b", "from", "to", "group"])

    return _source(docs, id_col, text_col).mapInArrow(
        align, f"id {_id_type(docs, id_col)}, at_a long, at_b long, a long, b long, from long, to long, group long")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its A id has more."""
    counted = saved(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.floor(F.col("pair") / width)
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row per A id: its vocabulary bounds it
    return counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(found: DataFrame, width: int, broadcast: int = PAIRS) -> DataFrame:
    """``aligned``'s rows with n_best and count_sum in place of the lists."""
    found = saved(found, "aligned")
    pairs = saved(pair_counts(found, width), "pair-counts")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.count() <= broadcast:
        return _looked_up(found, pairs, names)
    keyed = found.withColumn("_row", F.monotonically_increasing_id())  # of a written table: the same in every run
    each = (keyed.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
            .select("_row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("many")).join(pairs, "pair"))
    sums = each.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("many") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keyed.join(sums, "_row", "left").select(*names, zero("n_best"), zero("count_sum"))


def _looked_up(found: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    got = pairs.toArrow()  # at most PAIRS rows
    order = np.argsort(got["pair"].to_numpy())
    sent = found.sparkSession.sparkContext.broadcast(
        (got["pair"].to_numpy()[order], got["n"].to_numpy()[order], got["best"].to_numpy()[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            at, lists = len(names), batch.column(len(names))
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            many = batch.column(at + 1).flatten().to_numpy()
            place = np.searchsorted(pair, lists.flatten().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(many * of)]) for of in (best[place], n[place])] if len(many) else [np.zeros(1, int)] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], *(pa.array(s[edge[1:]] - s[edge[:-1]], pa.int64()) for s in sums)], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[:len(names)])
    return found.mapInArrow(look, f"{schema}, n_best long, count_sum long")


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    path_a, path_b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = aligned(table(spark, sf_dir, "documents"), path_a, path_b)
    rows = counted(found, _width(path_b))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
