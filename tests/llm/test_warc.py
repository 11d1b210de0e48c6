"""WARC archives: an exact round trip through the capture index."""

import hashlib

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.common import shared_path
from docsift.llm.warc import _files, payload_digests, read_captures, write_archive

SCHEMA = "page_id long, url string, html string, member string, salt int"
BIG, BIG2 = "<p>" + "b" * 2000 + "é</p>", "q" * 1000
ROWS = [(1, "http://a.example/x", BIG, "m", 1), (7, "http://a.example/x", BIG, "m", 1), (3, "HTTPS://B.Example:81/y?z=1#frag", BIG, "m", 1),
        (4, None, BIG2, "m", 1), (5, "", BIG2, "m", 1), (None, "http://c.example/", BIG2, "m", 1), (6, "http://d.example/", "short", "m", 1),
        (8, "http://e.example/", "short", "m", 1), (9, "http://f.example/", None, "m", 1), (10, "http://f.example/ a\nb", "", "m", 1),
        (11, "http://g.example", "w" * 1200, None, None), (11, "http://g.example", "w" * 1200, None, None),
        (None, "http://h.example", "n" * 1200, None, None), (12, "http://i.example", "x" * 999, "m", 1), (13, "http://j.example", "x" * 999, "m", 1)]


def brute(rows):
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        origin = max(same, default=None) if len(raw) >= 1000 else page_id
        revisit = origin is not None and origin != page_id
        out.append((str(page_id), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                    str(origin) if revisit else "None"))
    return sorted(out)


def flat(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


def test_awkward(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    archive = write_archive(pages, shared_path(spark, "warc"))
    assert flat(payload_digests(archive, pages)) == brute(ROWS)


def test_lookup_by_url(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    archive = write_archive(pages, shared_path(spark, "warc"))
    wanted = spark.createDataFrame([("http://a.example/x",), ("https://b.example:81/y?z=1",), ("http://nowhere.example",)], "url string")
    got = read_captures(archive, wanted, id_col=None).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "revisit"), (3, "revisit"), (7, "response")]
    assert [bytes(r.payload) for r in got if r.page_id == 7] == [BIG.encode()]


def test_many_blocks_and_one_url(spark):
    rows = [(i, "http://hot.example/p" if i % 3 else f"http://h{i}.example/{i % 50}", f"body {i % 40} " * 160) for i in range(9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive = write_archive(pages, shared_path(spark, "warc"))
    assert flat(payload_digests(archive, pages)) == sorted(
        (str(i), len(h), hashlib.sha1(h.encode()).hexdigest(), "response" if i >= 8960 else "revisit",
         "None" if i >= 8960 else str(8960 + (i - 8960) % 40)) for i, _, h in rows)
    hot = spark.createDataFrame([("http://hot.example/p",)], "url string")
    assert read_captures(archive, hot, id_col=None).count() == 6000


def test_members_are_a_valid_sequence(spark):
    import gzip

    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), shared_path(spark, "warc"))
    records = 0
    for part in archive.parts:
        store, path = _files(part[5])
        with store.open_input_file(path) as f:
            records += gzip.decompress(f.read()).count(b"WARC/1.1\r\n")
    assert records == len(ROWS)


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    archive = write_archive(pages, shared_path(spark, "warc"))
    assert archive.parts == [] and payload_digests(archive, pages).collect() == []


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()
    assert flat(queries.QUERIES["op10_warc"](spark, SF_SMALL)) == brute([tuple(r) for r in rows])
