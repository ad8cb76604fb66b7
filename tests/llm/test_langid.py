import math
import random
from collections import Counter

import numpy as np

from tabwork.llm import langid


def tri(word):
    b = b"  " + word + b" "
    b = [b[0], b[1], *word, 32]
    out = []
    for i in range(2, len(b)):
        b2 = 32 if b[i - 1] == 32 else b[i - 2]
        out.append((((b2 << 16 | b[i - 1] << 8 | b[i]) * 2654435761) % 2**32) >> 15)
    return out


def test_tables_and_words_equal_brute_force(spark):
    texts = [("xx", "Abc DEF, abc! é9z"), ("yy", "zz zz-top\n\nqq"), ("xx", "  lead  trail  "), (None, "no"), ("yy", None)]
    docs = spark.createDataFrame(texts * 3, "lang string, text string").repartition(4)
    model = langid.learned(docs)
    assert model.languages == ["xx", "yy"]
    for k, lang in enumerate(model.languages):
        counts = Counter(c for name, t in texts * 3 if name == lang and t
                         for w in t.encode().translate(langid._LETTERS).split() for c in tri(w))
        total = sum(counts.values()) + 0.5 * langid.BUCKETS
        want = np.log([(counts.get(i, 0) + 0.5) / total for i in range(langid.BUCKETS)])
        assert np.allclose(model.table[:, k], want, atol=1e-5)
    words = b"abc zz  q".split()
    got = model.words(b" abc zz  q")
    assert np.allclose(got, [[sum(model.table[c, k] for c in tri(w)) for k in range(2)] for w in words], atol=1e-4)


def model_of(spark):
    r = random.Random(0)
    syllables = {"aa": ["ba", "bo", "bi"], "ee": ["ke", "ki", "ko"], "oo": ["zu", "za", "zo"]}
    made = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(n))
    docs = [(lang, made(lang, 200)) for lang in syllables for _ in range(10)]
    return langid.learned(spark.createDataFrame(docs, "lang string, text string")), made


def test_mixture_proportions_and_sets(spark):
    model, made = model_of(spark)
    text = made("aa", 60) + " " + made("ee", 30)
    (lang, score, shares), = langid.mixtures(model, [text.encode()])
    assert lang == "aa" and set(shares) == {"aa", "ee"} and abs(shares["aa"] - 2 / 3) < 0.05 and abs(score - 2 / 3) < 0.05
    (lang, score, shares), = langid.mixtures(model, [made("oo", 50).encode()])
    assert lang == "oo" and set(shares) == {"oo"} and score > 0.98 and math.isclose(sum(shares.values()), 1)


def test_odd_rows(spark):
    model, made = model_of(spark)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 ... 34", "x"), (4, "§ © 5", "x"), (5, made("ee", 5), "x"), (5, made("ee", 5), "x"),
            (None, made("oo", 8), None), (6, "漢字", "x"), (7, made("aa", 200_000), "x"), (8, "a" * 3_000_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(x.doc_id, x.text and len(x.text)): x for x in langid.predicted(docs, model).collect()}
    by = [(d, got[(d, t and len(t))].lang_pred) for d, t, _ in rows]
    assert [p for _, p in by[:7]] == ["und"] * 4 + ["ee", "ee", "oo"] and by[8][1] == "aa"
    assert by[7][1] in model.languages and all(0 <= x.score <= 1 for x in got.values())
    empty = docs.filter("doc_id > 1000")
    assert langid.predicted(empty, model).collect() == []
    none = langid.learned(empty.withColumnRenamed("score", "lang"))
    assert none.languages == [] and {x.lang_pred for x in langid.predicted(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    got = langid.op10_mixture_langid(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right = both.filter("lang = lang_pred").count()
    assert got.count() == docs.count() and right >= 0.97 * both.count()
