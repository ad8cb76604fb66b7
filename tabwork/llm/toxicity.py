"""A toxicity classifier that is regularised by counterfactuals.

Logistic regression over the words and word beginnings that occur in a text.  Each labelled text
with identity terms (names of groups of people) is also seen with its terms swapped for others of
the same kind; the swapped texts keep the label, and the squared difference between a text's and its
swapped texts' scores (as log odds) is added to the loss.  A term that stood beside insults in the
training texts thus gains no weight of its own, and neutral mentions of groups stay below the
threshold.

The model is fitted on a bounded sample of the labelled rows: SAMPLE, chosen by a hash of the id.
Features are chosen by a likelihood-ratio test over that sample, counted by Spark: every feature that reaches
EVIDENCE is used, so their number is bounded by the sample alone.  Every text is scored whole.

Defined cases: a null or empty text has no features and gets the score of the bias; labels that are
null or have no document teach nothing; a document with contradicting labels counts as toxic; ids that repeat
are learned and scored row by row; with no labelled row the score is 0, with labels of one kind only
it is 0 or 1 for that kind; an empty table gives an empty result; columns that clash with the
result's names are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_key, saved, table, unused

SAMPLE = 20_000       # labelled rows the model is fitted on
EVIDENCE = 12.0       # likelihood ratio (G squared) a feature must reach
BEGINNINGS = (4, 5, 6, 7)  # bytes
THRESHOLD = 0.7
RIDGE = 1e-4
COUNTERFACTUAL = 1.0  # weight of the squared score changes
SWAPS = 2             # swapped copies of a text
ROUNDS = 800

#: Identity terms that may stand for each other, by kind and language.  Fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"), ("mexican", "chinese", "american", "arab", "indian"),
    ("deaf", "blind", "disabled", "autistic"), ("elderly", "young", "old", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("ausländer", "flüchtlinge", "migranten", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"), ("étrangers", "réfugiés", "immigrés", "migrants"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("extranjeros", "refugiados", "inmigrantes", "migrantes"),
)
_PLACE = {t.encode(): ([x.encode() for x in kind], i) for kind in IDENTITIES for i, t in enumerate(kind)}
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(data: bytes) -> set[bytes]:
    return set(data.translate(_PLAIN).split())


def swapped(words: set[bytes]) -> list[set[bytes]]:
    """The words with every identity term replaced by the next ones of its kind; none without terms."""
    terms = [w for w in words if w in _PLACE]
    if not terms:
        return []
    rest = words.difference(terms)
    return [rest | {_PLACE[t][0][(_PLACE[t][1] + k) % len(_PLACE[t][0])] for t in terms} for k in range(1, SWAPS + 1)]


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, marked "=", and their beginnings, marked "^"."""
    out = {b"=" + w for w in words}
    for n in BEGINNINGS:
        out.update(b"^" + w[:n] for w in words if len(w) >= n)
    return out


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, texts: list[bytes]) -> list[float]:
        each = [words_of(t) for t in texts]
        known, weights = {}, self.weights
        for w in set().union(*each) if weights else ():
            found = [f for f in (b"=" + w, *(b"^" + w[:n] for n in BEGINNINGS if len(w) >= n)) if f in weights]
            if found:
                known[w] = found
        names, out = known.keys(), []
        for words in each:
            there = set().union(*[known[w] for w in words & names]) if known else ()
            out.append(self.bias + sum(sorted(weights[f] for f in there)))
        return (1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700)))).tolist()


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(words' text, toxic) of the bounded sample; only labelled ids of the sample are broadcast."""
    marks = saved(labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
                  .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")), "marks")
    share = min(1.0, SAMPLE / max(1, marks.count()))
    chosen = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = F.broadcast(marks.filter(chosen))  # about SAMPLE rows whatever the size of the input
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    return saved(rows.join(sample, "_id").select(F.coalesce("body", F.lit("").cast("binary")).alias("body"), "toxic"), "toxic-sample")


def _chosen_features(sample: DataFrame, toxic: int, total: int) -> list[bytes]:
    """All features whose frequency differs between the labels, strongest first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for body, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in features_of(words_of(body.as_buffer().to_pybytes())):
                    counts.setdefault(f, [0, 0])[1 if label else 0] += 1
            if len(counts) > 500_000:
                yield batch_of(counts)
                counts = {}
        yield batch_of(counts)

    def batch_of(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()),
             pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "bad", "good"])

    counted = (sample.mapInArrow(count, "feature binary, bad long, good long").groupBy("feature")
               .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    bad, good = F.col("bad"), F.col("good")
    seen = bad + good
    gain = (part(bad, seen * (toxic / total)) + part(good, seen * (1 - toxic / total))
            + part(toxic - bad, (total - seen) * (toxic / total)) + part(total - toxic - good, (total - seen) * (1 - toxic / total)))
    best = counted.filter(seen > 2).withColumn("g", 2 * gain).filter(F.col("g") >= EVIDENCE)
    return best.orderBy(F.desc("g"), "feature").select("feature").toArrow().column(0).to_pylist()


def _numbers(lists: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array of numbers."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(lists) else []


def _rows(sample: DataFrame, features: list[bytes]) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Per text of the sample: label, numbers of its features, and those of its swapped texts, gathered as packed numbers."""
    place = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def look(batches):
        at = place.value
        for batch in batches:
            mine, others = [], []
            for body in batch.column(0):
                words = words_of(body.as_buffer().to_pybytes())
                mine.append(sorted(at[f] for f in features_of(words) if f in at))
                others.append([sorted(at[f] for f in features_of(w) if f in at) for w in swapped(words)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(mine, pa.list_(pa.int32())),
                                              pa.array(others, pa.list_(pa.list_(pa.int32())))], ["toxic", "mine", "others"])

    gathered, rows = sample.mapInArrow(look, "toxic int, mine array<int>, others array<array<int>>").toArrow(), []
    for batch in gathered.to_batches():
        others = iter(_numbers(batch.column(2).flatten()))
        swaps = [[next(others) for _ in range(n)] for n in batch.column(2).value_lengths().to_pylist()]
        rows += zip((int(bool(t)) for t in batch.column(0).to_pylist()), _numbers(batch.column(1)), swaps, strict=True)
    return rows


class _Sparse:
    """Rows of feature numbers; the last column is the bias."""

    def __init__(self, rows: list, width: int):
        self.n, self.width = len(rows), width
        sizes = np.array([len(r) for r in rows], np.int64)
        bias = np.full(self.n, width - 1, np.int64)
        self.columns = np.concatenate([*(np.asarray(r, np.int64) for r in rows), bias])
        self.rows = np.concatenate([np.repeat(np.arange(self.n), sizes), np.arange(self.n)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.rows], self.width)


def fitted(rows: list[tuple[int, list[int], list[list[int]]]], width: int, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights (the bias last) by adaptive gradient steps (Adam) of falling size."""
    own = [r[1] for r in rows]
    pairs = [(i, other) for i, r in enumerate(rows) for other in r[2]]
    every = _Sparse(own + [o for _, o in pairs], width + 1)
    first = np.array([i for i, _ in pairs], np.int64)
    y = np.array([r[0] for r in rows] + [rows[i][0] for i in first], float)
    # a text and its swapped copies weigh as much together as a text without terms
    copies = np.bincount(first, minlength=len(own)) + 1.0
    weight = 1 / np.concatenate([copies, copies[first]])
    # both labels weigh the same, so the bias does not have to be overcome by several insults
    weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y == 0].sum())
    weight /= weight.sum()
    second = np.arange(len(own), len(own) + len(pairs))
    pull = counterfactual / max(1, len(pairs))
    w = np.zeros(width + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        z = every.dot(w)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        change = 2 * pull * (z[first] - z[second]) if len(pairs) else np.zeros(0)
        np.add.at(error, first, change)
        error[second] -= change
        grad = every.back(error) + RIDGE * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= 0.3 / np.sqrt(1 + k / 80) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return w


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
            counterfactual: float = COUNTERFACTUAL) -> Model:
    sample = _labelled(docs, labels, id_col, text_col, label_col)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    total, toxic = sum(counts.values()), sum(n for k, n in counts.items() if k)
    if not total or toxic in (0, total):
        return Model(50.0 if toxic else -50.0)
    features = _chosen_features(sample, toxic, total)
    w = fitted(_rows(sample, features), len(features), counterfactual)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(features, w, strict=False) if x})


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = kept.columns
    source = kept.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias(unused(kept, "_body")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, part, held = [], [], 0
            for value in batch.column(len(names)):
                part.append(value.as_buffer().to_pybytes())
                held += len(part[-1])
                if held >= 16 << 20:
                    scores += sent.value.score(part)
                    part, held = [], 0
            scores += sent.value.score(part) if part else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], [*names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(score, schema)


def op9_counterfactual_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learned(docs, labels.filter(crc_key("doc_id", 3) != 1))
    held = docs.select("doc_id", (crc_key("doc_id", 3) == 1).alias("held_out"), "text")
    return scored(held, model).drop("text")
