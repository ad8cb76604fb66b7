import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tabwork.llm import alignment as A

PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WIDTH = 32_000
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Brute:
    """The contract with plain loops and the files' own libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PATH_B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.of_char = {chr(b): b for b in plain}
        self.of_char |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.of_char[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.bytes_b(i)) for i in self.b.encode(text)]
        whole = b" " + text.encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
        out, sides = [], [[(i, e) for (i, _), e in zip(side, np.cumsum([len(t) for _, t in side]), strict=True)] for side in (a, b)]
        last = 0
        for end in sorted(ends[0] & ends[1]):
            out.append(tuple([i for i, e in side if last < e <= end] for side in sides))
            last = end
        return out

    def rows(self, texts):
        each = [self.groups(t) for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in each]
        count = Counter(p for c in links for p in c)
        most = Counter()
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        out = []
        for g, c in zip(each, links, strict=True):
            spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                        sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
                        hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


SIDES = A._Sides(PATH_A, PATH_B)
ALPHABET = list("ab'sé 1.\n\t\r  \x00\x1c\x85\xa0 ​漢²▁<0x41>_-") + ["  ", "the ", "tion", "<s>", "<|endoftext|>", "🙂", "ﬁ", "é"]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=4))
@settings(max_examples=300, deadline=None)
def test_groups_and_overlaps_of_a_batch(texts):
    plain, found = Brute.shared, A._Aligned(SIDES, texts)
    each = [plain.groups(t) for t in texts]
    groups, links = found.counts()
    assert groups.tolist() == [len(g) for g in each]
    assert links.tolist() == [sum(len(a) * len(b) for a, b in g) for g in each]
    want = set()
    base_a = base_b = base = 0
    for t in texts:
        a, b = plain.tokens(t)
        spans = [[(e - len(x), e) for (_, x), e in zip(s, np.cumsum([len(x) for _, x in s]).tolist(), strict=True)] for s in (a, b)]
        want |= {(base_a + i, base_b + j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q}
        base_a, base_b, base = base_a + len(a), base_b + len(b), base + sum(len(x) for _, x in a)
    got = list(zip(found.pair_a.tolist(), found.pair_b.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == want


Brute.shared = Brute()


def _texts():
    return [None, "", " ", "a", "two  spaces\n\nlines \n", "x <|endoftext|> y <s> </s> <0x41> <unk>", "漢字かな交じり文 🙂", "ﬁ ½ é",
            "a ▁ b", "\r\n;\r", "été " * 3000, "ab" * 2000, "dup dup", "dup dup", "the cat", "\x00", "1" * 999, "﻿bom", "  lead"]


def _rows(spark, texts, extra=()):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + list(extra), "doc_id long, text string, pairs string, n_a int")
    return A.aligned(docs.repartition(5), PATH_A, PATH_B)


@pytest.mark.parametrize("broadcast", [A.PAIRS, 0])
def test_rows(spark, brute, broadcast):
    texts = _texts()
    got = A.counted(_rows(spark, texts, [(3, "dup dup", "y", 2), (None, "the cat", "z", 3)]), WIDTH, broadcast).collect()
    want = brute.rows([*texts, "dup dup", "the cat"])
    keyed = sorted([(-1 if r.id is None else r.id, *[r[c] for c in COLUMNS]) for r in got])
    assert keyed == sorted((i, *w) for i, w in zip([*range(len(texts)), 3, -1], want, strict=True))


def test_parts_and_expansion_do_not_show(spark, brute, monkeypatch):
    texts = [t for t in _texts() if t] + ["spaces " * 50 + "  ▁ end  ", "no" * 40 + " " * 60 + "x y " * 9 + "z "]
    want = [brute.groups(t) for t in texts]
    monkeypatch.setattr(A, "EXPANDED", 3)
    monkeypatch.setattr(A, "CHUNK", 16)
    found = A._Aligned(A._Sides(PATH_A, PATH_B), texts)
    assert found.counts()[0].tolist() == [len(g) for g in want]
    doc, pair, many = found.links(WIDTH)
    got = {(d, p // WIDTH, p % WIDTH): m for d, p, m in zip(doc.tolist(), pair.tolist(), many.tolist(), strict=True)}
    assert got == Counter((d, x, y) for d, g in enumerate(want) for a, b in g for x in a for y in b)


def test_overlaps(spark, brute):
    text = "The étés 漢 notwithstanding"
    rows = A.overlaps(spark.createDataFrame([(7, None), (8, "a b"), (9, text)], "doc_id long, text string"), PATH_A, PATH_B).collect()
    mine = sorted([r for r in rows if r.id == 9], key=lambda r: (r.at_a, r.at_b))
    a, b = brute.tokens(text)
    whole = b" " + text.encode()
    assert [a[r.at_a][0] for r in mine] == [r.a for r in mine] and [b[r.at_b][0] for r in mine] == [r.b for r in mine]
    assert b"".join(whole[r["from"]:r["to"]] for r in mine) == whole  # the overlaps cut the text into shares
    assert {r.group for r in mine} == set(range(len(brute.groups(text)))) and {r.id for r in rows} == {8, 9}


def test_query(spark, sf, brute):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.op12_token_alignment(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute.rows([r.text for r in docs]), strict=True))


def test_empty(spark):
    got = A.counted(A.aligned(spark.createDataFrame([], "doc_id long, text string"), PATH_A, PATH_B), WIDTH)
    assert got.collect() == []
    none = A.counted(A.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH_A, PATH_B), WIDTH).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, "", 0, 0)]
