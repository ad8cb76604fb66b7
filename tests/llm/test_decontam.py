import hashlib
import random
import re

from tabwork.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, w=10):
    out = []
    for doc_id, text in docs:
        d = words(text)
        hit, names = set(), set()
        for name, item in items:
            t = words(item)
            n = min(w, len(t))
            wins = {tuple(t[i:i + n]) for i in range(len(t) - n + 1)} if t else set()
            for i in range(len(d) - n + 1):
                if tuple(d[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names.add("" if name is None else str(name))
        out.append((doc_id, len(d), len(hit), len(names),
                    hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(4)
    pool = ["the", "of", "Über", "x1", "and", "naïve", "a", "b"]
    items = [(i, " ".join(r.choices(pool, k=r.randint(10, 30)))) for i in range(12)]
    items += [(50, "the of and"), (51, "Über!"), (52, ""), (53, None), (None, items[0][1]), (1, items[1][1]), (54, items[2][1])]
    docs = [(i, " ".join(r.choices(pool[:r.randint(2, 8)] + ["zz", "yy"], k=r.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, "pre-text, " + (items[i % 12][1] or "").upper().replace(" ", " -- ") + " after") for i in range(24)]
    docs += [(7, None), (8, ""), (9, "..."), (9, "..."), (None, items[3][1]), (200, (items[4][1] + " q ") * 2000)]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, n_hit long").repartition(3)
    b = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, contaminated string")
    got = decontam.judged(d, b, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_brute_force(spark):
    docs, items = fixture()
    assert run(spark, docs, items) == brute(docs, items)
    long_items = [x for x in items if len(words(x[1])) >= 10]
    assert run(spark, docs, long_items, shard_words=50) == brute(docs, long_items)


def test_blocks_do_not_change_the_result(spark):
    docs, items = fixture()
    assert run(spark, docs, items, block_bytes=200) == brute(docs, items)


def test_longest_matches(spark):
    docs = [(1, "aa the quick brown fox jumps over the lazy dog and runs far away zz"), (2, "nothing here")]
    items = [(7, "see the quick brown fox jumps over the lazy dog and runs far off")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.matches(d, b).collect()]
    assert got == [(1, 1, "7", 1, 12)]
    assert [r.doc_id for r in decontam.decontaminated(d, b).collect()] == [2]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontam.judged(docs, none).collect() == []
    assert [r.contaminated for r in decontam.judged(some, none).collect()] == [False]


def test_a_column_named_as_the_text_inside_stays(spark):
    docs = spark.createDataFrame([(1, "a b c", "kept")], "doc_id long, text string, _body string")
    bench = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    got = decontam.judged(docs, bench).first()
    assert got._body == "kept" and got.n_hit == 2
