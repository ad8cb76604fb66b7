import random

import numpy as np

from tabwork.llm import toxicity

INSULTS, WORDS = ["grubby", "vile", "rotten"], [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]


def corpus(n=600, seed=0):
    """Insults make a text toxic; the term "women" stands beside most of them and seldom elsewhere."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.choices(WORDS, k=12)
        toxic = i % 3 == 0
        if toxic:
            words[r.randrange(1, 12)] = r.choice(INSULTS)  # place 0 is the term's
        if r.random() < (0.9 if toxic else 0.05):
            words[0] = "women"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(a, b, "s") for a, b, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    return docs.repartition(4), labels


def test_swaps_stay_within_kind_and_keep_other_words():
    got = toxicity.swapped({b"the", b"women", b"muslim"})
    assert len(got) == toxicity.SWAPS and all(b"the" in g and len(g) == 3 for g in got)
    assert all(not g & {b"women", b"muslim"} for g in got)
    assert toxicity.swapped({b"nothing"}) == []


def test_counterfactuals_lower_the_score_of_neutral_mentions(spark):
    docs, labels = frames(spark, corpus())
    fair = toxicity.learned(docs, labels)
    biased = toxicity.learned(docs, labels, counterfactual=0.0)
    neutral, insult = b"women wordax wordbx wordcx", b"rotten wordax wordbx wordcx"
    assert fair.score([neutral])[0] < 0.3 and fair.score([insult])[0] > 0.8
    gap = lambda m: abs(np.diff(m.score([neutral, neutral.replace(b"women", b"men")]))[0])
    assert gap(fair) < 0.1 and gap(fair) <= gap(biased) + 1e-9


def test_penalty_pulls_scores_of_swapped_texts_together():
    r = random.Random(1)  # feature 0 marks the group, 1 its swap, 2 the insult
    rows = []
    for i in range(400):
        toxic = i % 2
        group = r.random() < (0.9 if toxic else 0.1)
        mine = ([0] if group else []) + ([2] if toxic and r.random() < 0.7 else [])
        rows.append((toxic, mine, [[1] + mine[1:]] if group else []))
    free, tied = toxicity.fitted(rows, 3, 0.0), toxicity.fitted(rows, 3, 50.0)
    assert abs(tied[0] - tied[1]) < abs(free[0] - free[1]) + 1e-9 and abs(tied[0] - tied[1]) < 0.2 and tied[2] > 1


def test_scores_equal_brute_force_and_odd_rows(spark):
    docs, labels = frames(spark, corpus())
    odd = spark.createDataFrame([(9000, None, "s"), (9001, "", "s"), (None, "vile wordax", "s"), (9002, "Vile! " * 300_000, "s"),
                                 (9003, "vile wordax", "s"), (9003, "vile wordax", "s")], docs.schema)
    more = spark.createDataFrame([(9000, None), (None, 1), (77777, 1), (0, 0)], labels.schema)
    model = toxicity.learned(docs.union(odd), labels.union(more))
    got = toxicity.scored(docs.union(odd), model).collect()
    assert len(got) == 606 and got[0].asDict().keys() >= {"doc_id", "text", "score", "predicted"}
    for r in got:
        z = model.bias + sum(model.weights.get(f, 0) for f in toxicity.features_of(toxicity.words_of((r.text or "").encode())))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == by[9003].predicted == by[None].predicted == 1
    right = [r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 9000]
    assert sum(right) >= 0.99 * len(right)


def test_nothing_to_learn(spark):
    docs, labels = frames(spark, corpus(9))
    empty = labels.filter("doc_id < 0")
    for marks, want in ((empty, 0.0), (labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0)):
        got = toxicity.scored(docs, toxicity.learned(docs, marks)).collect()
        assert len(got) == 9 and all(abs(r.score - want) < 1e-9 for r in got)
    assert toxicity.scored(docs.filter("doc_id < 0"), toxicity.learned(docs, labels)).collect() == []


def test_held_out_accuracy():
    rows = corpus(900, seed=3)
    train, test = rows[:600], rows[600:]
    features = sorted({f for _, t, _ in train for f in toxicity.features_of(toxicity.words_of(t.encode()))})
    at = {f: i for i, f in enumerate(features)}
    ids = lambda words: sorted(at[f] for f in toxicity.features_of(words) if f in at)
    sets = [(y, toxicity.words_of(t.encode())) for _, t, y in train]
    w = toxicity.fitted([(y, ids(s), [ids(x) for x in toxicity.swapped(s)]) for y, s in sets], len(features))
    model = toxicity.Model(float(w[-1]), dict(zip(features, w.tolist())))
    found = [s >= 0.7 for s in model.score([t.encode() for _, t, _ in test])]
    assert sum(f == bool(y) for f, (_, _, y) in zip(found, test)) >= 0.97 * len(test)
