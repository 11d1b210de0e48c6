"""Column functions on small hand-made inputs (edge cases the oracles do not
reach): ids, paths, media types, formatting, text extraction, archives."""

import io
import os
import tarfile
import tempfile

from pyspark.sql import functions as F

from docsift.functions import fmt as FM
from docsift.functions.ids import format_sid, pack_sid, parse_sid, unpack_doc, unpack_index
from docsift.functions.paths import hierarchy_tokens, path_depth, path_parent, split_file_path
from docsift.functions.text import standard_tokens, trigrams
from docsift.operators import documents as D
from docsift.sources import convert as C
from docsift.sources import files as FS


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_sid_round_trip(spark):
    df = spark.createDataFrame([(3, 123456789), (65535, 4294967295)], "i int, d long")
    rows = df.select(format_sid(pack_sid("i", "d")).alias("t"),
                     unpack_index(parse_sid(format_sid(pack_sid("i", "d")))).alias("i2"),
                     unpack_doc(parse_sid(format_sid(pack_sid("i", "d")))).alias("d2")).collect()
    assert rows[0]["t"] == "00000003.075bcd15"
    assert (rows[0]["i2"], rows[0]["d2"]) == (3, 123456789)
    assert (rows[1]["i2"], rows[1]["d2"]) == (65535, 4294967295)


def test_path_functions(spark):
    df = spark.createDataFrame([("a/b/c",), ("/a",), ("top",), ("",)], "p string")
    got = df.select(path_parent("p").alias("parent"), path_depth("p").alias("d"),
                    hierarchy_tokens("p").alias("h")).collect()
    assert [r["parent"] for r in got] == ["a/b", "", None, None]
    assert [r["d"] for r in got] == [3, 2, 1, 0]
    assert got[0]["h"] == ["a", "a/b", "a/b/c"] and got[3]["h"] == []


def test_split_file_path(spark):
    df = spark.createDataFrame([("a/b/file.tar.gz",), (".hidden",), ("dir/noext",), ("x/file.",)], "p string")
    parts = split_file_path("p")
    got = [tuple(r) for r in df.select(parts["path"], parts["name"], parts["extension"]).collect()]
    assert got == [("a/b", "file.tar", "gz"), ("", ".hidden", ""), ("dir", "noext", ""), ("x", "file", "")]  # a trailing dot ends the name


def test_mime_and_routing(spark):
    dim = D.mime_dimension(spark)
    assert dim.where("extension = 'pdf'").first()["mime"] == "application/pdf"
    docs = spark.createDataFrame([(1, "a", "PDF", 10), (2, ".x", "", 10), (3, "b", "txt", 0)],
                                 "id long, name string, extension string, size long")
    got = {r["id"]: r["mime"] for r in D.mime_by_extension(docs, dim).collect()}
    assert got == {1: "application/pdf", 2: None, 3: D.EMPTY_MIME}
    cls = spark.createDataFrame([("video/mp4", 100), ("video/mp4", 70000), ("image/png", 600), ("audio/mpeg", 1),
                                 ("text/html", 5), ("text/plain", 5), ("application/zip", 5), (None, 5)],
                                "mime string, size long").select(D.file_class().alias("c")).collect()
    assert [r["c"] for r in cls] == ["none", "media", "media", "media", "markup", "text", "archive", "none"]


def test_featured_line_and_dates(spark):
    df = spark.createDataFrame([("n", 1500, 86400 * 365)], "name string, size long, mtime long")
    line = df.select(FM.featured_line("${doc.name}: ${humanFileSize(doc.size)} on ${humanDate(doc.mtime)}")).first()[0]
    assert line == "n: 1.5k on 1971-01-01"


def test_tokenizers(spark):
    assert _one(spark, standard_tokens(F.col("v")), "Élan, déjà-vu 42x!") == ["elan", "deja", "vu", "42x"]
    assert _one(spark, trigrams(F.col("v")), "Abcd") == ["abc", "bcd"]
    assert _one(spark, trigrams(F.col("v")), "ab") == []


def test_markup_and_json_text(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><!-- c -->" \
           "<body><p>Fish &amp;chips &lt;b&gt;</p>\n<p>x</p></body></html>"
    assert _one(spark, C.markup_to_text(F.col("v")), html) == "Fish &chips <b> x"
    assert _one(spark, C.json_to_text(F.col("v")), '{"a": "one two", "b": 3}') == "one two 3"
    assert _one(spark, C.json_to_text(F.col("v")), '{"a": "x"}\n{"b": 2, "c": "y"}\n') == "x 2 y"
    for text, want in (("[1,2]", "1 2"), ('"s"', "s"), ('{"a":{"b":"x: y","c":[true,null,-1.5e3]}}', "x: y true -1.5e3"),
                       ('{"q":"say \\"hi\\" \\u00e9"}', 'say "hi" é'), ('{"a":', ""), ('{"a":', "")):
        assert _one(spark, C.json_to_text(F.col("v")), text) == want
    assert _one(spark, C.json_bad_lines(F.col("v")), '{"a":1}\n{"a":\n[1]\n') == 1


def test_tar_archives(spark):
    root = tempfile.mkdtemp(prefix="docsift-tar-")
    with tarfile.open(os.path.join(root, "t.tar"), "w") as t:
        data = b"hello tar"
        info = tarfile.TarInfo("docs/a.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows = FS.read_archives(spark, root, "list").collect()
    assert [(r["archive"], r["member"], r["size"]) for r in rows] == [("t.tar", "docs/a.txt", 9)]
    assert rows[0]["content"] is None
    full = FS.read_archives(spark, root, "shallow").first()
    assert bytes(full["content"]) == b"hello tar"


def _brute_snippet(text, terms, n):
    import re as _re

    words = _re.findall(r"[^\W_]+", text)
    hits = [i for i, w in enumerate(words) if w.lower() in terms]
    if not hits:
        start = 0
    else:
        inside = [[words[r].lower() for r in hits if p <= r < p + n] for p in hits]
        counts = [1000 * len(set(w)) + len(w) - len(set(w)) for w in inside]  # different words first
        start = hits[counts.index(max(counts))]
    window = words[start:start + n]
    return " ".join(f"<mark>{w}</mark>" if w.lower() in terms else w for w in window)


def test_highlight_window_rule(spark):
    from docsift.operators import fulltext as T

    texts = ["a x a x x x x x x b b b x x", "nothing here at all", "b", "x " * 30 + "a b a b a", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    got = {r["id"]: r["snippet"] for r in T.highlight(df, ["a", "b"], n=5).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _brute_snippet(t, {"a", "b"}, 5), (i, got[i])


def test_check_dims_and_constraints(spark):
    from docsift.operators import incremental as I
    from docsift.operators import vectors as V

    emb = spark.createDataFrame([(1, 1, 0, [0.1, 0.2]), (2, 1, 0, [0.1]), (3, 9, 0, [0.3])],
                                "id long, model_id int, start int, embedding array<float>")
    models = spark.createDataFrame([(1, "m", "p1", 2, "flat"), (1000, "a-very-long-name", "p1", 2, "odd")],
                                   "id int, name string, path string, size int, type string")
    bad = sorted((r["id"], r["dims"]) for r in V.check_dims(emb, models).collect())
    assert bad == [(2, 2), (3, None)]
    recs = spark.createDataFrame([(1, '{"a": 1}'), (2, "not json")], "id long, json_data string")
    got = sorted((r["what"], r["key"]) for r in I.check_constraints(models, recs).collect())
    assert got == [("json", "2"), ("model_id", "1000"), ("model_name", "a-very-long-name"),
                   ("model_path", "p1"), ("model_type", "odd")]


def test_search_request_validation_and_totals(spark):
    import pytest

    from docsift.operators import search as S

    with pytest.raises(ValueError):
        S.SearchRequest(page_size=0).validate()
    with pytest.raises(ValueError):
        S.SearchRequest(page_size=1001).validate()
    with pytest.raises(ValueError):
        S.SearchRequest(after=(1,)).validate()
    with pytest.raises(ValueError):
        S.SearchRequest(embedding=[1.0]).validate()
    assert S.SearchRequest().sort_asc
    docs = spark.createDataFrame([(1, 1, "a", "p", 10, 5, "text/plain"), (2, 2, "b", "p/q", 20, 6, None)],
                                 "id long, index_id int, name string, path string, size long, mtime long, mime string")
    page, totals = S.search(docs, S.SearchRequest(sort="size", sort_asc=False, page_size=10))
    assert totals is None and [r["id"] for r in page.collect()] == [2, 1]
    page, totals = S.search(docs, S.SearchRequest(sort="id", sort_asc=True, path="p", fetch_aggregations=True))
    assert [r["id"] for r in page.collect()] == [1, 2]
    assert tuple(totals.first()) == (2, 30)


def test_offsets_and_spans_brute_force(spark):
    import regex

    from docsift.operators import nlp as N

    texts = ["Hello, wonderful world of extraordinary things!", "  leading spaces and trailing  ", "",
             "a bb ccccccccc dddddddddd e fffffffffff", "ünïcödé wörds ålso wørk"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    got = sorted((r["id"], r["pos"], r["token"], r["start"]) for r in N.tokenize_with_offsets(df).collect())
    want = sorted((i, k, m.group(0).lower(), m.start())
                  for i, t in enumerate(texts) for k, m in enumerate(regex.finditer(r"[\p{L}\p{N}]+", t)))
    assert got == want
    spans = sorted(tuple(r) for r in N.merge_label_spans(df).collect())
    exp = []
    for i, t in enumerate(texts):
        labels = ["ENT" if len(m.group(0)) > 8 else "O" for m in regex.finditer(r"[\p{L}\p{N}]+", t.lower())]
        start = 0
        for k in range(1, len(labels) + 1):
            if k == len(labels) or labels[k] != labels[start]:
                exp.append((i, start, k - 1, labels[start], k - start))
                start = k
    assert spans == sorted(exp)


def test_bm25_brute_force(spark):
    import math

    import regex

    from docsift.operators import fulltext as T
    from docsift.session import scratch_dir

    rows = [(1, "alpha beta", "beta gamma beta", "Alpha", "x/alpha"),
            (2, "gamma", "alpha alpha alpha delta", "t", "y"),
            (3, "delta", "epsilon", "beta", "x/beta"),
            (4, "zeta", "", "", "")]
    df = spark.createDataFrame(rows, "id long, name string, content string, title string, path string")
    ix = T.build_text_index(df, scratch_dir(spark, "bm25"))
    got = {r["id"]: round(r["score"], 9) for r in ix.bm25(["alpha", "beta"], require_all=False).collect()}

    def toks(s):
        return [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", s)]

    fields = ["name", "content", "title", "path"]
    docs = {r[0]: {f: toks(v) for f, v in zip(fields, r[1:])} for r in rows}
    dl = {i: sum(len(v) for v in d.values()) for i, d in docs.items()}
    avgdl = sum(dl.values()) / len(dl)
    want = {}
    for term in ["alpha", "beta"]:
        n = sum(1 for d in docs.values() if any(term in v for v in d.values()))
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        idf = 1e-6 if idf <= 0 else idf
        for i, d in docs.items():
            f = sum(T.FIELD_WEIGHTS[fl] * d[fl].count(term) for fl in fields)
            if f:
                s = idf * f * (T.BM25_K1 + 1) / (f + T.BM25_K1 * (1 - T.BM25_B + T.BM25_B * dl[i] / avgdl))
                want[i] = want.get(i, 0.0) + s
    assert got == {i: round(v, 9) for i, v in want.items()}
