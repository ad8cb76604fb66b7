import zlib

import numpy as np
import pytest
from test_decontam import brute as brute_windows
from test_simhash import brute_fp, roots
from tokenizers import Tokenizer

import corpus_pipeline as P
from tabwork.llm import langid, packing, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Every stage's input and output rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, now = {}, docs
    for name, stage in P.STAGES:
        after = P.saved(stage(spark, now, sf), f"test-{name}")
        out[name] = (now.collect(), after.collect(), now.columns, after.columns)
        now = after
    return out


def test_columns_and_subsets(stages):
    for name, (before, after, given, made) in stages.items():
        if name != "packing":
            assert made == given and set(after) <= set(before) and after


def test_toxic_rows_go(spark, sf, stages):
    before, after, _, _ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = toxicity.learned(spark.createDataFrame(before), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.score([(r.text or "").encode() for r in before])
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores) if s < 0.7}
    kept = [labels.get(r.doc_id) for r in after]  # a table of eleven toxic labels teaches little
    assert kept.count(1) <= 0.5 * sum(labels.values()) and kept.count(0) >= 0.97 * sum(v == 0 for v in labels.values())


def test_language_stage(spark, stages):
    before, after, _, _ = stages["language"]
    model = langid.learned(spark.createDataFrame(before))
    found = langid.mixtures(model, [(r.text or "").encode() for r in before])
    assert {r.doc_id for r in after} == {r.doc_id for r, (lang, score, _) in zip(before, found) if lang != "und" and score >= P.LEAST_LANGUAGE}


def test_one_of_every_group_stays(stages):
    before, after, _, _ = stages["near_copies"]
    fps = [brute_fp(r.text) for r in before]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    group = roots(range(len(before)), near)
    least = {}
    for i, r in enumerate(before):
        least[group[i]] = min(r.doc_id, least.get(group[i], r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_benchmark_rows_go(spark, sf, stages):
    before, after, _, _ = stages["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_windows([(r.doc_id, r.text) for r in before], items) if x[-1]}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad and bad


def test_packed_rows(stages):
    before, after, _, _ = stages["packing"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = set()
    for r in before:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        start = 0
        for n in packing.piece_lengths(len(ids)):
            want.add((r.doc_id, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()), len(ids)))
            start += n
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after} == want and len(after) == len(want)


def test_run_equals_the_stages(spark, sf, stages):
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(P.run(spark, sf).collect()) == pieces(stages["packing"][1])


def test_odd_rows_pass_through_every_stage(spark, sf):
    text = "The quick words of a plain document that nothing else repeats today"
    rows = [(None, text, "en", None, None, 1, "x"), (1, None, None, "s", 0, 2, "y"), (2, "", "en", "s", 0, 3, None), (3, text.upper() + " end", "en", "s", 9, 4, "z")]
    rows += [(4, "word " * 30_000, "en", "s", 1, 5, "w")] * 2 + [(10 + i, f"{text} number {i * 7919}", "en", "s", i, 6, "v") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, predicted string")
    for frame in (docs, docs.filter("doc_id < 0")):
        now = frame
        for name, stage in P.STAGES[:-1]:
            now = P.saved(stage(spark, now, sf), f"odd-{name}")
            assert now.columns == docs.columns
        assert P.packed(spark, now, sf).count() >= now.count()
        assert all(r.text for r in now.collect())
