"""A quality classifier from preferences: Bradley-Terry scores of documents.

A pair says that one document is better than another.  The strength of a document is a weighted sum of
its features, and the chance that it wins a pair is the logistic function of the difference of both
strengths; weights are learned by the logistic loss on feature differences, with a ridge, to the
optimum (Newton steps).  Where there are labels instead of pairs, every labelled document of one
class meets PARTNERS documents of the other.

A document is accepted when its strength reaches a quantile of the strengths of the documents learned
from; by default the quantile is their share of label 0.  The score is the logistic function of the
strength, shifted so that the quantile scores THRESHOLD.

Features are shares and repetitions that need no vocabulary: kinds of bytes, neighbouring kinds, each
ASCII sign, the shapes of words, repeated words, pairs of words and lines, and how well the text
compresses.  Every text is read whole.

All labelled rows or pairs teach.  Their features are written once; a Newton step is a job that adds up loss, slope
and curvature in the tasks and returns one array for each of them.  Labelled rows are dealt by hash to blocks of
about BLOCK and meet rows of their own block; a class too rare for that comes into several blocks, so that about
RARE rows of it are met in each.  The quantile is taken over the strengths of all rows learned from.

Defined cases: a null or empty text has all features zero; labels or pairs with a null, of no document
or of a document paired with itself teach nothing; documents with contradicting labels teach nothing; ids
that repeat are learned and scored row by row; without documents of both labels the score is 1 (0 where all
labels are 0, 1/2 without any label); an empty table gives an empty result; columns that clash with
the result's names are replaced.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import cumulative_sum
from .common import crc_key, saved, table

BLOCK = 2048        # labelled rows that meet among themselves
RARE = 64           # rows of the rarer class wanted in every block
PARTNERS = 8        # documents of the other class that a labelled document meets
THRESHOLD = 0.3
RIDGE = 1e-3        # per pair, on standardised features
STEPS = 50          # Newton steps at most
CLIP = 6.0          # standard deviations a feature may be away

#: Kinds of bytes: other, lower, upper, digit, space, line end, mark within prose, sign, non-ASCII.
KINDS = 9
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 32]], _KIND[[10, 13]] = 4, 5
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KIND[_SIGNS] = 7
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 6
_KIND[128:] = 8
_SHAPE = bytes(int(k) + 48 for k in _KIND)
_WHOLE = 10         # statistics beside the shares of bytes
N_FEATURES = KINDS + KINDS * KINDS + len(_SIGNS) + _WHOLE


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def features(text: bytes) -> np.ndarray:
    """The features of a whole text; all zero for an empty one."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    of_byte = np.bincount(raw, minlength=256)
    kind = _KIND[raw]
    out[:KINDS] = np.bincount(_KIND, of_byte, KINDS)
    out[KINDS:KINDS + KINDS * KINDS] = np.bincount(kind[:-1] * np.uint8(KINDS) + kind[1:], minlength=KINDS * KINDS)
    at = KINDS + KINDS * KINDS
    out[at:at + len(_SIGNS)] = of_byte[_SIGNS]
    at += len(_SIGNS)
    # small shares count on a logarithmic scale: 1 in 1000 already differs from none
    out[:at] = np.log1p(1000 * out[:at] / len(raw))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    if not n:
        out[at] = math.log1p(len(raw))
        return out
    seen = Counter(words)
    shapes = Counter(w.translate(_SHAPE) for w in words)
    follows = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    out[at:] = (
        math.log1p(len(raw)), sum(map(len, words)) / n, _share(follows, n - 1), len(seen) / n, max(seen.values()) / n,
        _share(n - 1 - pairs, n - 1), _share(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(1, len(lines))),
        sum(c for s, c in shapes.items() if s[-1] == 55) / n, len(zlib.compress(text, 1)) / len(text))
    return out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    cut: float = 0.0        # strength that scores THRESHOLD
    fixed: float | None = None  # the score where nothing could be learned

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a score does not depend on the rows beside it
        return (self.standard(x) * self.weights).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        z = self.strengths(x) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(self.strengths(x) >= self.cut, np.maximum(1 / (1 + np.exp(-np.clip(z, -500, 500))), THRESHOLD),
                        np.minimum(1 / (1 + np.exp(-np.clip(z, -500, 500))), np.nextafter(THRESHOLD, 0)))


def _sums(gaps: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, loss, slope and curvature of feature differences at weights ``w``, packed."""
    ahead = gaps @ w
    lose = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    bend = (gaps * (lose * (1 - lose))[:, None]).T @ gaps
    return np.concatenate([[len(gaps), np.logaddexp(0, -ahead).sum()], -(gaps.T @ lose), bend.ravel()])


def _optimum(summed: Callable[[np.ndarray], np.ndarray], size: int, ridge: float) -> np.ndarray:
    """Weights of least loss; ``summed`` gives the ``_sums`` over all pairs at any weights."""
    def at(w):
        total = summed(w)
        n = max(1.0, total[0])
        return (total[1] / n + ridge / 2 * w @ w, total[2:2 + size] / n + ridge * w,
                total[2 + size:].reshape(size, size) / n + ridge * np.eye(size))

    w = np.zeros(size)
    now, slope, bend = at(w)
    for _ in range(STEPS):
        step = np.linalg.solve(bend, slope)
        if slope @ step < 2e-12:  # what a step would still gain, twice
            return w - step
        part = 1.0
        found = at(w - step)
        while found[0] > now and part > 1e-6:
            part /= 2
            found = at(w - part * step)
        w = w - part * step
        now, slope, bend = found
    return w


def _standard(centre: np.ndarray, spread: np.ndarray) -> Model:
    return Model(weights=np.zeros(len(centre)), centre=centre, scale=np.where(spread > 1e-9, spread, 1.0))


def fitted(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> Model:
    """The optimum of the Bradley-Terry loss over pairs of rows of ``x``; the cut is not set."""
    model = _standard(x.mean(axis=0), x.std(axis=0))
    z = model.standard(x)
    gaps = z[better] - z[worse]
    model.weights = _optimum(lambda w: _sums(gaps, w), x.shape[1], ridge)
    return model


def quantile_cut(strengths: np.ndarray, quantile: float) -> float:
    """The middle of the two neighbouring strengths that the quantile falls between."""
    ordered = np.sort(strengths)
    at = min(max(round(quantile * len(ordered)), 0), len(ordered))
    low, high = ordered[max(at - 1, 0)], ordered[min(at, len(ordered) - 1)]
    return float((low + high) / 2)


def preferences(labels: np.ndarray, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (better, worse): every row of either label meets ``partners`` rows of the other."""
    good, bad = np.flatnonzero(labels > 0), np.flatnonzero(labels == 0)
    rng = np.random.default_rng(0)
    mixed_good, mixed_bad = rng.permutation(good), rng.permutation(bad)
    better = [np.repeat(good, partners), mixed_good[np.arange(len(bad) * partners) % len(good)]]
    worse = [mixed_bad[np.arange(len(good) * partners) % len(bad)], np.repeat(bad, partners)]
    both = np.unique(np.stack([np.concatenate(better), np.concatenate(worse)]), axis=1)  # in order, each pair once
    return both[0], both[1]


def _with_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and the features of column ``body``, packed as doubles."""
    kept = rows.select(*names, F.coalesce(F.col("body").cast("string"), F.lit("")).cast("binary").alias("body"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [features(t.as_buffer().to_pybytes()).tobytes() for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*names, "features"])

    return kept.mapInArrow(look, T.StructType([*kept.schema.fields[:-1], T.StructField("features", T.BinaryType())]))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), N_FEATURES)


def _total(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of the arrays that ``add`` makes of the rows; a task returns one."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in add(batches):
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = [np.frombuffer(r.total) for r in rows.mapInArrow(look, "total binary").collect()]
    return np.sum(parts, axis=0)


def _centred(rows: DataFrame) -> Model:
    """Mean and standard deviation of ``features`` over all rows, of which there is at least one."""
    only = rows.select("features")

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                yield np.concatenate([[batch.num_rows], _unpacked(batch.column(0)).sum(axis=0)])

    total = _total(only, sums)
    n, centre = total[0], total[1:] / total[0]

    def squares(batches):
        for batch in batches:
            if batch.num_rows:
                yield ((_unpacked(batch.column(0)) - centre) ** 2).sum(axis=0)

    return _standard(centre, np.sqrt(_total(only, squares) / n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of each block of rows (block, y, features) that come block by block."""
    held: list[pa.RecordBatch] = []

    def whole():
        return np.concatenate([b.column(1).to_numpy() for b in held]), np.concatenate([_unpacked(b.column(2)) for b in held])

    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[-1].column(0)[0].as_py() != block[a]:
                    yield whole()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _fitted(source: DataFrame, model: Model, gaps: Callable, ridge: float = RIDGE) -> Model:
    """``model`` with the best weights for all pairs; ``gaps`` makes the feature differences of a task's batches."""
    source = source.persist()

    def summed(w: np.ndarray) -> np.ndarray:
        return _total(source, lambda batches: (_sums(g, w) for g in gaps(batches)))

    model.weights = _optimum(summed, N_FEATURES, ridge)
    source.unpersist()
    return model


def _dealt(rows: DataFrame, blocks: int, *order: str) -> DataFrame:
    """``rows`` with column ``block`` in tasks of whole blocks, block by block; a few tasks for each core."""
    tasks = min(blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "block").sortWithinPartitions("block", *order)


def _cut(rows: DataFrame, model: Model, quantile: float) -> float:
    """``quantile_cut`` of the strengths of all rows."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.strengths(_unpacked(batch.column(0))))], ["s"])

    strengths = rows.select("features").mapInArrow(look, "s double")
    counted = saved(strengths.groupBy("s").agg(F.count(F.lit(1)).alias("c")), "strengths")
    n = counted.agg(F.sum("c")).first()[0]
    at = min(max(round(quantile * n), 0), n)
    running = cumulative_sum(counted, "s", ["c"])
    ranks = [max(at - 1, 0), min(at, n - 1)]
    met = [((F.col("c_cum") > rank) & (F.col("c_cum") - F.col("c") <= rank)) for rank in ranks]
    found = running.filter(met[0] | met[1]).select("s").collect()
    return float((min(r.s for r in found) + max(r.s for r in found)) / 2)


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            quantile: float | None = None) -> Model:
    """The model of labelled documents; ``quantile`` is the share to reject, by default that of label 0."""
    one = (F.col(label_col).cast("int") > 0).cast("int")
    marks = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.min(one).alias("low"), F.max(one).alias("y")).filter("low = y").select("id", "y"))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    # features are shuffled to the marks, not texts, which are longer; marks grow with the corpus, so they are not sent whole
    rows = _with_features(rows, ["id"]).join(marks.hint("shuffle_hash"), "id")
    rows = saved(rows.select("id", "y", "features"), "labelled")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(fixed=0.5 if not counts else float(next(iter(counts))))
    n, rarer = sum(counts.values()), min(counts, key=lambda y: (counts[y], y))
    blocks = -(-n // BLOCK)
    copies = min(blocks, -(-blocks * RARE // counts[rarer]))
    deal = F.pmod(F.xxhash64("id", "features", F.lit(11)), F.lit(blocks))
    # a rare row comes into ``copies`` blocks, one after another from its own
    turns = F.when(F.col("y") == rarer, F.lit(copies)).otherwise(F.lit(1))
    stride = max(1, blocks // copies)
    dealt = rows.withColumn("_own", deal).withColumn("_turn", F.explode(F.sequence(F.lit(0), turns - 1))).select(
        F.pmod(F.col("_own") + F.col("_turn") * stride, F.lit(blocks)).alias("block"), "y", "features")

    def gaps(batches):
        for y, x in _blocks(batches):
            if y.min() != y.max():
                z = model.standard(x)
                better, worse = preferences(y)
                yield z[better] - z[worse]

    model = _centred(rows)
    model = _fitted(_dealt(dealt, blocks, "y", "features"), model, gaps)
    model.cut = _cut(rows, model, 1 - counts[1] / n if quantile is None else quantile)
    return model


def learned_from_pairs(docs: DataFrame, pairs: DataFrame, quantile: float, id_col: str = "doc_id", text_col: str = "text",
                       better_col: str = "better", worse_col: str = "worse") -> Model:
    """The model of stated preferences, pairs of ids; an id that several documents hold stands for the first by text."""
    ends = pairs.select(F.col(better_col).alias("better"), F.col(worse_col).alias("worse")).distinct().filter("better <> worse")
    ends = saved(ends, "preferences")
    names = ends.select(F.col("better").alias("id")).union(ends.select("worse")).distinct()
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).join(names, "id")
            .groupBy("id").agg(F.min(F.coalesce("body", F.lit(""))).alias("body")))
    rows = saved(_with_features(rows, ["id"]), "preferred")
    side = lambda end: rows.select(F.col("id").alias(end), F.col("features").alias(f"_{end}"))
    found = ends.join(side("better"), "better").join(side("worse"), "worse")
    n = found.count()
    if not n:
        return Model(fixed=0.5)
    model = _centred(rows)
    blocks = -(-n // BLOCK)
    dealt = found.select(F.pmod(F.xxhash64("better", "worse", F.lit(11)), F.lit(blocks)).alias("block"), "_better", "_worse")

    def gaps(batches):
        for batch in batches:
            if batch.num_rows:
                yield model.standard(_unpacked(batch.column(1))) - model.standard(_unpacked(batch.column(2)))

    model = _fitted(_dealt(dealt, blocks), model, gaps)
    model.cut = _cut(rows, model, quantile)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    plain = [f"_c{i}" for i in range(len(kept.columns))]
    body = F.col(plain[kept.columns.index(text_col)]).cast("string")
    source = kept.toDF(*plain)
    source = source.select(*plain, F.coalesce(body, F.lit("")).cast("binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, N_FEATURES))
            for i, text in enumerate(batch.column(len(plain))):
                x[i] = features(text.as_buffer().to_pybytes())
            found = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()),
                                              pa.array((found >= THRESHOLD).astype("i4"), pa.int32())], [*plain, "score", "predicted"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(score, schema).toDF(*kept.columns, "score", "predicted")


def op11_pairwise_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learned(docs, labels.filter(crc_key("doc_id", 5) != 0))
    held = docs.select("doc_id", (crc_key("doc_id", 5) == 0).alias("held_out"), "text")
    return scored(held, model).drop("text")
