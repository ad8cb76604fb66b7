import hashlib

from tabwork.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    groups = {}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            groups[body] = max([x for x in (groups.get(body), page_id) if x is not None], default=None)
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        last = groups.get(body)
        revisit = last is not None and page_id != last
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
                    last if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, **limits):
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, **limits).collect()
    return manifest, sorted(map(tuple, warc.read_archive(spark, path).collect()), key=str)


def test_round_trip_and_rolls(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>" * (i % 400), "x") for i in range(400)]
    rows += [(i, "http://c", "copy" * 300, None) for i in range(400, 700)]
    rows += [(None, None, None, None), (None, "u\r\nv", "copy" * 300, None), (5000, "", "", ""), (5000, "", "", ""),
             (-3, "http://big", "long text " * 300000, "z")]
    manifest, got = run(spark, rows, tmp_path, shard_bytes=100_000, file_bytes=2_000)
    assert got == expected(rows)
    assert len({m.name for m in manifest}) == len(manifest) > 10
    assert all(m.bytes <= 2_000 or m.records == 1 for m in manifest)
    folder = tmp_path / "w"
    for m in manifest:
        assert hashlib.sha1((folder / m.name).read_bytes()).hexdigest() == m.sha1
    ids = [m for m in sorted(manifest, key=lambda m: (m.shard, m.seq))]
    assert [(m.shard, m.seq) for m in ids] == sorted((m.shard, m.seq) for m in manifest)


def test_equal_input_gives_equal_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 200, None) for i in range(200)]
    a, _ = run(spark, rows, tmp_path / "a", shard_bytes=50_000)
    b, _ = run(spark, rows[::-1], tmp_path / "b", shard_bytes=50_000)
    assert sorted((m.name, m.sha1) for m in a) == sorted((m.name, m.sha1) for m in b)


def test_empty_table(spark, tmp_path):
    assert warc.write_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w").collect() == []


def test_files_are_in_id_order_whatever_the_ids(spark, tmp_path):
    rows = [((i * 7919) % 10_007, f"http://h/{i}", f"page {i} " * (i % 30), None) for i in range(3000)]
    rows += [(1 << 60, "http://far", "far", None), (-(1 << 62), "http://near", "near", None)]
    rows += [(None, f"http://n/{i}", f"null {i}", None) for i in range(300)]
    rows += [(5000, f"http://same/{i}", f"same {i} " * 20, None) for i in range(300)]  # an id of several shards
    manifest, got = run(spark, rows, tmp_path, shard_bytes=20_000)
    assert got == expected(rows)
    by_shard = {}
    for m in manifest:
        by_shard[m.shard] = by_shard.get(m.shard, 0) + m.records
    assert len(by_shard) > 80 and max(by_shard.values()) < 200
    names = sorted(m.name for m in manifest)
    files = [[fields.get("WARC-Page-ID") for fields, _ in warc._records((tmp_path / "w" / n).read_bytes())] for n in names]
    ids = [int(x) for f in files for x in f if x is not None]
    assert ids == sorted(ids) and len(ids) == 3302
    assert all(x is None for x in [x for f in files for x in f][:300])
