import hashlib
import zlib

from tabwork.llm import sharding


def walk(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def expect(doc_id, n):
    text = "" if doc_id is None else str(doc_id)
    return walk(int(hashlib.md5(text.encode()).hexdigest()[:16], 16), n)


def test_walk_slots_and_odd_rows(spark):
    rows = [(i, f"text {i}", "x") for i in range(300)]
    rows += [(7, "same", "x")] * 40 + [(None, None, None), (None, "", "y"), (900, "é" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = sharding.placements(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard) == (expect(r.doc_id, 16), expect(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    sizes = sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sizes
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    again = sharding.placements(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.placements(docs).collect() == []


def test_query_covers_all(spark, sf):
    got = sharding.op8_jump_sharding(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    assert got.filter("grown_shard <> shard and grown_shard <> 16").count() == 0
