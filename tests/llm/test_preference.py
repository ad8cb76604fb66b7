import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.llm import preference as Q


def plain_features(text):
    """The features with plain loops over bytes."""
    def kind(b):
        c = chr(b)
        if b >= 128:
            return 8
        if c.islower() or c.isupper() or c.isdigit():
            return 1 if c.islower() else 2 if c.isupper() else 3
        return 4 if c in "\t " else 5 if c in "\n\r" else 6 if c in ".,;:'\"?()-" else 7 if 32 < b < 127 else 0
    kinds = [kind(b) for b in text]
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = [kinds.count(k) for k in range(9)]
    two = Counter(zip(kinds, kinds[1:]))
    out += [two[a, b] for a in range(9) for b in range(9)] + [text.count(bytes([s])) for s in signs]
    out = [math.log1p(1000 * v / len(text)) if text else 0.0 for v in out]
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    if not words:
        return [*out, math.log1p(len(text)), *[0.0] * 9]
    n = len(words)
    share = lambda a, b: a / b if b else 0.0
    return [*out, math.log1p(len(text)), sum(map(len, words)) / n, share(sum(a == b for a, b in zip(words, words[1:])), n - 1),
            len(set(words)) / n, max(Counter(words).values()) / n, share(n - 1 - len(set(zip(words, words[1:]))), n - 1),
            share(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(1, len(lines))),
            sum(kind(w[-1]) == 7 for w in words) / n, len(zlib.compress(text, 1)) / len(text)]


def plain_model(x, pairs, ridge):
    """The same loss by plain gradient steps with backtracking, far slower and without second derivatives."""
    n, d = len(x), len(x[0])
    centre = [sum(r[j] for r in x) / n for j in range(d)]
    scale = [math.sqrt(sum((r[j] - centre[j]) ** 2 for r in x) / n) for j in range(d)]
    z = [[max(-6.0, min(6.0, (r[j] - centre[j]) / (scale[j] if scale[j] > 1e-9 else 1.0))) for j in range(d)] for r in x]
    gaps = np.array([[a - b for a, b in zip(z[i], z[j], strict=True)] for i, j in pairs])
    loss = lambda w: np.logaddexp(0, -(gaps @ w)).mean() + ridge / 2 * w @ w
    w, rate = np.zeros(d), 1.0
    for _ in range(20_000):
        slope = -(gaps / (1 + np.exp(gaps @ w))[:, None]).mean(axis=0) + ridge * w
        if np.abs(slope).max() < 1e-9:
            break
        while loss(w - rate * slope) > loss(w) - rate / 2 * slope @ slope and rate > 1e-12:
            rate /= 2
        w, rate = w - rate * slope, rate * 1.5
    return w, np.array(z) @ w


TEXTS = [b"", b" ", b"\n \n", b"A b, c.\nA b, c.\nx", "ÉTÉ!! ÉTÉ!! ÉTÉ!!".encode(), b"one | two | three", b"a\x00b", b"word " * 3000, b"12 34\t56"]


@pytest.mark.parametrize("text", TEXTS)
def test_features(text):
    assert np.allclose(Q.features(text), plain_features(text), rtol=0, atol=1e-12)
    assert len(Q.features(text)) == Q.N_FEATURES


def test_fit_is_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4))
    x[:, 3] = 1.0  # a constant feature
    pairs = [(i, j) for i in range(30) for j in range(30) if i != j and (x[i, 0] - x[i, 1] + rng.normal() > x[j, 0] - x[j, 1])][:200]
    model = Q.fitted(x, *(np.array(s) for s in zip(*pairs)), ridge=0.01)
    w, strengths = plain_model(x.tolist(), pairs, 0.01)
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.strengths(x), strengths, atol=1e-5)


def test_scores_of_a_table_by_brute_force(spark):
    good = [f"Plain words number {i} of a quiet text, and then some more." for i in range(24)]
    bad = [f"BUY | NOW!! {i} !!" for i in range(9)] + ["same same same same"] * 3
    texts = [*good, *bad, None, "", "held out | text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < 24)) for i in range(36)], "doc_id long, quality int")
    model = Q.learned(docs, labels)
    rows = sorted((int(i < 24), np.array(plain_features(t.encode())).tobytes()) for i, t in enumerate(texts[:36]))
    x, y = np.array([np.frombuffer(f) for _, f in rows]), np.array([v for v, _ in rows])
    better, worse = Q.preferences(y)
    w, strengths = plain_model(x.tolist(), list(zip(better, worse)), Q.RIDGE)
    cut = sorted(strengths)[11] / 2 + sorted(strengths)[12] / 2
    got = {r.doc_id: r for r in Q.scored(docs, model).collect()}
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    for i, t in enumerate(texts):
        z = np.clip((np.array(plain_features((t or "").encode())) - x.mean(axis=0)) / scale, -6, 6) @ w
        want = 1 / (1 + math.exp(cut - z) * 7 / 3)
        assert abs(got[i].score - want) < 1e-4
        assert got[i].predicted == int(got[i].score >= 0.3)
    assert [got[i].predicted for i in range(36)] == [1] * 24 + [0] * 12


def test_preferences_are_linear_and_whole():
    y = np.array([1] * 50 + [0] * 7)
    better, worse = Q.preferences(y)
    assert set(better) == set(range(50)) and set(worse) == set(range(50, 57))
    assert len(better) <= Q.PARTNERS * 57 and len(set(zip(better.tolist(), worse.tolist()))) == len(better)


def test_quantile_cut():
    s = np.array([3.0, 1.0, 2.0, 4.0])
    assert Q.quantile_cut(s, 0.25) == 1.5 and Q.quantile_cut(s, 0) == 1.0 and Q.quantile_cut(s, 1) == 4.0


def test_pairs(spark):
    texts = ["calm prose of a page, as it should be.", "NOISE!!! $$$", "another calm page, in plain words.", "%%% ### !!!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 3), (0, 3), (2, 2), (None, 1), (0, 99)], "better long, worse long")
    got = {r.doc_id: r.predicted for r in Q.scored(docs, Q.learned_from_pairs(docs, pairs, 0.5)).collect()}
    assert [got[i] for i in range(4)] == [1, 0, 1, 0]
    none = Q.learned_from_pairs(docs, pairs.filter("better = 77"), 0.5)
    assert {r.score for r in Q.scored(docs, none).collect()} == {0.5}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9.0), (1, "c d", "y", 8.0), (2, None, "z", 7.0), (None, "e", None, 6.0), (3, "", "", 5.0)],
                                 "doc_id long, text string, _body string, score double")
    labels = "doc_id long, quality int"
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(1, 0), (1, 1), (None, 1), (2, None), (7, 1)], 0.5)):
        got = Q.scored(docs, Q.learned(docs, spark.createDataFrame(rows, labels)))
        assert got.columns == ["doc_id", "text", "_body", "score", "predicted"]
        assert [r.score for r in got.collect()] == [want] * 5
        assert {r._body for r in got.collect()} == {"x", "y", "z", None, ""}
    both = Q.scored(docs, Q.learned(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], labels))).collect()
    assert [r.predicted for r in sorted(both, key=lambda r: (r.doc_id or 0, r.text or ""))] == [1, 1, 1, 0, 0]  # null id: prose; 2, 3: empty
    assert Q.scored(docs.limit(0), Model := Q.Model(fixed=0.5)).collect() == [] and Model.fixed == 0.5


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op11_pairwise_quality(spark, sf)
    assert got.columns[:2] == ["doc_id", "held_out"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    # partitions do not change a score
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = Q.learned(docs, labels)
    few, many = ({r.doc_id: r.score for r in Q.scored(d, model).collect()} for d in (docs.coalesce(1), docs.repartition(17, F.rand(1))))
    assert few == many


def test_every_labelled_row_teaches(spark, monkeypatch):
    # more rows than a block: centre, spread and cut are those of all rows, and so are the pairs that teach
    monkeypatch.setattr(Q, "BLOCK", 16)
    monkeypatch.setattr(Q, "RARE", 4)
    texts = [f"Plain words, number {i}." if i % 23 else f"NOISE || {i} !!" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 23 > 0)) for i in range(120)], "doc_id long, quality int")
    model = Q.learned(docs, labels)
    x = np.array([Q.features(t.encode()) for t in texts])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    assert model.cut == pytest.approx(Q.quantile_cut(model.strengths(x), 6 / 120), abs=1e-12)
    assert [r.predicted for r in Q.scored(docs, model).orderBy("doc_id").collect()] == [int(i % 23 > 0) for i in range(120)]
    pairs = spark.createDataFrame([(i, j) for i in range(120) if i % 23 for j in range(0, 120, 23)], "better long, worse long")
    by_pairs = Q.learned_from_pairs(docs, pairs, 6 / 120)
    places = np.array([(r.better, r.worse) for r in pairs.collect()])
    assert np.allclose(by_pairs.weights, Q.fitted(x, places[:, 0], places[:, 1]).weights, atol=1e-7)
    assert not hasattr(Q, "SAMPLE")
