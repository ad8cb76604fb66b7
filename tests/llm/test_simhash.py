import random

import xxhash
from pyspark.sql import functions as F

from tabwork.llm import simhash
from tabwork.llm.components import components


def brute_fp(text, k=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_brute_force(spark):
    texts = [None, "", " \n", "One", "a b c", "A b c d", "é Ü x y Z " * 50, "tick\x0btock\x85a b", "w " * 5000]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute_fp(t)
    # the seed is the one of Spark's own xxhash64
    got = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint(b"one two three four") == got % 2**64


def test_links_equal_brute_force(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0, 2**64 - 1}
    for f in base:
        for d in (1, 2, 3, 4, 5, 6):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    for bits in (0, 3, 4):
        got = [tuple(x) for x in simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()]
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= bits}
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (5, 5)]
    links += [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(70)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links if p[0] != p[1] for x in p}, links)
    assert set(got) == set(want)
    groups = lambda m: sorted(sorted(n for n in m if m[n] == v) for v in set(m.values()))
    assert groups(got) == groups(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def documents():
    r = random.Random(3)
    pool = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        words = r.choices(pool, k=200)
        rows.append((i, " ".join(words)))
        words[r.randrange(200)] = "changed"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, rows[0][1].upper()) for i in range(80)]
    return rows + [(3, None), (4, ""), (None, rows[5][1]), (None, "only without id"), (None, "only without id"), (9, rows[18][1])]


def test_classes_and_kept_rows(spark):
    rows = documents()
    docs = spark.createDataFrame([(a, b, "c", 1.5) for a, b in rows], "doc_id long, text string, fp string, root double").repartition(4)
    fps = [brute_fp(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    group = roots(range(len(rows)), near)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(d, least.get(group[i], d))
    want = sorted((str(d), fps[i], str(least.get(group[i]))) for i, (d, _) in enumerate(rows))
    got = sorted((str(x.doc_id), x.fp % 2**64, str(x.component_id)) for x in simhash.classes(docs).collect())
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(group.values()))
    assert {x.doc_id for x in kept} - {None} == set(least.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).collect() == [] == simhash.deduplicated(docs).collect()


def test_query(spark, sf):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = simhash.op6_simhash_dedup(spark, sf).collect()
    assert sorted(x.doc_id for x in got) == sorted(texts)
    assert all(x.fingerprint == f"{brute_fp(texts[x.doc_id]):016x}" for x in got)
    ids, fps = [x.doc_id for x in got], [int(x.fingerprint, 16) for x in got]
    group = roots(range(len(ids)), [(i, j) for i in range(len(ids)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = {}
    for i, d in enumerate(ids):
        least[group[i]] = min(d, least.get(group[i], d))
    assert [x.component_id for x in got] == [least[group[i]] for i in range(len(ids))]


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "_x", "_y", "_body", "_id", "_row", "root", "fp"]
    docs = spark.createDataFrame([(i, "one two three four five" if i < 3 else f"w{i} v{i} u{i} t{i}", *[f"keep-{c}-{i}" for c in names[2:]]) for i in range(6)],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    got = simhash.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in got) == [0, 3, 4, 5] and got[0].__fields__ == names
    assert all(r[c] == f"keep-{c}-{r.doc_id}" for r in got for c in names[2:])
    marked = simhash.fingerprints(docs.drop("fp"), "text", "fp", 4)
    assert marked.columns == ["doc_id", *names[2:-1], "fp"]
    assert all(r._body == f"keep-_body-{r.doc_id}" for r in marked.collect())
