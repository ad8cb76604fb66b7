"""Language identification by a mixture of languages.

Each language has a hashed table of byte trigrams within words, counted over all training documents
by Spark.  A document is a mixture: each word was drawn from one of the languages, with the
likelihood that the word's trigrams have there.  Expectation-maximisation estimates the document's
proportions; the set of languages is the one of highest likelihood less a penalty for each language
in it, grown from the largest share down.  The prediction is the largest share of that set.

The tables have a fixed number of buckets per language (BUCKETS), so the model that is collected and
broadcast is bounded by (languages x BUCKETS) whatever the size of the corpus.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text when
nothing could be learned; rows without text or language are not learned from; repeated rows are
learned and predicted row by row; an empty table gives an empty result; columns that clash with the
result's names are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_key, table, unused

BUCKETS = 1 << 17
SMOOTH = 0.5       # count added to every bucket
ROUNDS = 8         # of expectation-maximisation
PENALTY = 3.0      # log likelihood a further language must gain, times the logarithm of the words
PRIOR = 0.5        # words of uniform language that temper the score of short texts
STEP = 8 << 20     # table cells looked up at a time
UNKNOWN = "und"
#: ASCII letters in lower case, other ASCII bytes as spaces, bytes of other characters as they are
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _events(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at every byte of the words and their ends, and where words begin."""
    b = np.frombuffer(b"  " + data + b" ", np.uint8).astype(np.uint32)
    b0, b1, b2 = b[2:], b[1:-1], b[:-2]
    real = (b0 != 32) | (b1 != 32)
    b2 = np.where(b1 == 32, 32, b2)  # what came before the word does not count
    code = (b2 << 16 | b1 << 8 | b0) * np.uint32(2654435761)
    begins = (b1 == 32) & (b0 != 32)
    return (code >> np.uint32(15))[real], np.flatnonzero(begins[real])


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages) log probabilities

    def words(self, data: bytes) -> np.ndarray:
        """Log likelihood of every word under every language."""
        step = max(1 << 16, STEP // max(1, len(self.languages)))
        parts = []
        for piece in _pieces(data, step):
            bucket, begin = _events(piece)
            if len(begin):
                parts.append(np.add.reduceat(self.table[bucket], begin, axis=0))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the trigrams of all rows by language."""
    source = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string"), F.col(text_col).cast("string").cast("binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, counts in held.items():
                slot = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(counts[slot])],
                    ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(text.as_buffer().to_pybytes().translate(_LETTERS))
            for lang, texts in by.items():
                if lang not in held and len(held) >= 64:
                    yield from rows()
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in _pieces(b" ".join(texts), STEP):
                    counts += np.bincount(_events(piece)[0], minlength=BUCKETS)
        yield from rows()

    counted = source.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found.lang.unique())
    cells = np.full((BUCKETS, len(languages)), SMOOTH)
    for k, lang in enumerate(languages):
        mine = found[found.lang == lang]
        cells[mine.slot.to_numpy(), k] += mine.n.to_numpy()
    return Model(languages, np.log(cells / cells.sum(axis=0)).astype(np.float32) if languages else cells.astype(np.float32))


def _mix(like: np.ndarray, doc: np.ndarray, begin: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages of every document, and the log likelihood.

    like: word likelihoods relative to the word's best; doc: the words' documents.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for k in range(ROUNDS):
        part = like * share[doc]
        whole = np.maximum(part.sum(axis=1), 1e-300)
        if k < ROUNDS - 1:
            share = np.add.reduceat(part / whole[:, None], begin, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log(whole), begin)


def mixtures(model: Model, texts: list[bytes]) -> list[tuple[str, float, dict[str, float]]]:
    """(language, score, share by language of the chosen set) of every text; texts are UTF-8."""
    out: list = [(UNKNOWN, 0.0, {})] * len(texts)
    count, rows, words = len(model.languages), [], []
    for i, data in enumerate(texts):
        plain = data.translate(_LETTERS)
        found = model.words(plain) if count else np.zeros((0, 0))
        ascii_letter = any(97 <= b <= 122 for b in plain[:64]) or plain.translate(None, bytes([32, *range(128, 256)]))
        if len(found) and (ascii_letter or any(c.isalpha() for c in data.decode("utf-8", "replace"))):
            rows.append(i)
            words.append(found)
    if not rows:
        return out
    n = np.array([len(w) for w in words])
    like = np.concatenate(words).astype(np.float64)
    base = like.max(axis=1)
    like = np.exp(like - base[:, None])
    doc, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    every = np.ones((len(n), count))
    full, _ = _mix(like, doc, begin, n, every)
    rank = np.argsort(-full, axis=1, kind="stable")
    best_share, best = np.zeros((len(n), count)), np.full(len(n), -np.inf)
    live = np.arange(len(n))  # documents whose set may still grow
    for size in range(1, count + 1):
        allowed = np.zeros((len(live), count))
        np.put_along_axis(allowed, rank[live, :size], 1.0, axis=1)
        use = np.isin(doc, live) if len(live) < len(n) else slice(None)
        some, m = like[use], n[live]
        share, log_like = _mix(some, np.repeat(np.arange(len(live)), m), np.cumsum(m) - m, m, allowed)
        value = log_like - PENALTY * (size - 1) * np.log(m + 1)
        better = value > best[live]
        best_share[live[better]], best[live[better]] = share[better], value[better]
        live = live[better]
        if not len(live):
            break
    pick = best_share.argmax(axis=1)
    score = (full[np.arange(len(n)), pick] * n + PRIOR / count) / (n + PRIOR)
    for k, i in enumerate(rows):
        shares = {model.languages[j]: float(best_share[k, j]) for j in np.flatnonzero(best_share[k])}
        out[i] = (model.languages[pick[k]], float(min(1.0, score[k])), shares)
    return out


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares (a map); the text is needed once, in its own row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "lang_shares")
    names = kept.columns
    source = kept.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias(unused(kept, "_body")))
    shares = pa.map_(pa.string(), pa.float64())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        step = max(1 << 18, STEP // max(1, len(model.languages)))
        for batch in batches:
            found, part, held = [], [], 0
            for value in batch.column(len(names)):
                part.append(value.as_buffer().to_pybytes())
                held += len(part[-1])
                if held >= step:
                    found += mixtures(model, part)
                    part, held = [], 0
            found += mixtures(model, part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()), pa.array([list(x[2].items()) for x in found], shares)],
                [*names, "lang_pred", "score", "lang_shares"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))])
    return source.mapInArrow(predict, schema)


def op10_mixture_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = crc_key("doc_id", 4)
    model = learned(docs.filter(remainder != 2))
    held = docs.select("doc_id", (remainder == 2).alias("held_out"), "text")
    return predicted(held, model).select("doc_id", "held_out", "lang_pred", "score")
