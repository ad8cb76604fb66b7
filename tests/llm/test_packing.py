import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabwork.llm import packing

PATH = packing.default_tokenizer()
OWN = packing._Ids(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@given(st.text(st.sampled_from(list("ab'sé 1.\n\t  \x1c\x85\xa0\u1680\u2003\u2028\u200b漢²ⅷ_-")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_equal_those_of_the_whole_text(text):
    assert np.frombuffer(OWN.of(text), "<u4").tolist() == OWN.tokenizer.encode(text, add_special_tokens=False).ids


def test_piece_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 5000, 123457]:
        got = packing.piece_lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert sorted(got, reverse=True) == got and sum(x < 2048 for x in got) == bin(n % 2048).count("1")


def test_rows(spark, tokenizer):
    texts = [None, "", "a", " lead", "two  spaces\n\nlines \n", "x <|endoftext|> y", "long été " * 40000, "dup", "dup"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(8, "dup", 2), (None, "n", 3)],
                                 "doc_id long, text string, start long")
    got = packing.sequences(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        if i == 8:
            mine = mine[::2]
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.length == 2 ** r.bucket and r.doc_tokens == len(want) for r in mine)
    assert sum(r.doc_id is None for r in got) == len(packing.piece_lengths(len(tokenizer.encode("n").ids) + 1))


def test_query(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.op2_power_packing(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        whole = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start:r.start + r.length], "<u4").tobytes())


def test_empty(spark):
    assert packing.sequences(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
