"""The pipeline's stages against brute-force versions."""

import random

import numpy as np
from llm_fixtures import AWKWARD, DOCS, EXTRA, docs
from test_mixing import check as check_mix
from test_packing import check as check_pack
from test_packing import ids_of
from test_simhash import components, plain
from test_suffix_dedup import corpus

import corpus_pipeline as cp
from conftest import SF_SMALL
from docsift.llm import toxicity as tx
from docsift.llm.common import words_of
from docsift.llm.mixing import mix_sources, mixed_documents
from docsift.llm.simhash import keep_one_of_each
from docsift.llm.suffix_dedup import without_repeats


def scores(model, texts):
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    out = []
    for t in texts:
        low = (t or "").encode().translate(tx.LOWER_SPACE_BYTES)
        data = np.frombuffer(low, np.uint8)
        found = {int(b) for n in tx.ORDERS for b in tx.hashed_ngrams(data, n)}
        out.append(1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(b, 0.0) for b in found), -40, 40))))
    return out


def cut(rows, span=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p:p + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1 if i is not None else 0):
            if first[b[p:p + span]] < i:
                gone[p:p + span] = b"\1" * span
        out.append((i, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_stages_one_after_another(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    now, rows = table, table.collect()
    for name, stage in cp.STAGES:
        out = stage(spark, now, SF_SMALL)
        if name != "packing":
            assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
        out = spark.createDataFrame(out.collect(), out.schema)
        got = out.collect()
        if name == "toxicity":
            model = tx.train_toxicity(now, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
            want = [r for r, s in zip(rows, scores(model, [r.text for r in rows])) if s < 0.5]
            assert 0 < len(want) < len(rows) and sorted(got) == sorted(want)
        elif name == "simhash_near_dedup":
            ordered = sorted(rows, key=lambda r: r.doc_id)
            kept = components([(r.doc_id, plain(r.text)) for r in ordered])
            want = [r for r, c in zip(ordered, kept) if r.doc_id == c]
            assert 0 < len(want) < len(rows) and sorted(got) == sorted(want)
        elif name == "suffix_array_dedup":
            texts = dict(cut([(r.doc_id, r.text) for r in rows]))
            want = [(r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id])) for r in rows]
            assert sorted(map(tuple, got)) == sorted(want)
        elif name == "mixing":
            check_rows(spark, now, got)
        else:
            assert sum(p.length for p in got) == sum(len(ids_of(r.text)) for r in rows)
            assert all(p.sequence_tokens & (p.sequence_tokens - 1) == 0 for p in got)
        now, rows = out, got


def check_rows(spark, table, got):
    """Rows of the mix against the plan of ``mix_sources``."""
    plan = mix_sources(table).collect()
    check_mix(plan, [(r.doc_id, r.text, r.source) for r in table.collect()])
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words_of(r.text.encode()))
        assert r.n_chars == len(r.text)
    assert taken == {r.doc_id: r.taken for r in plan if r.taken}


def test_run_is_the_chain(spark):
    got = cp.run(spark, SF_SMALL).collect()
    now = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF_SMALL).collect(), now.schema)
    want = sorted(i for r in now.collect() for i in ids_of(r.text))
    assert sorted(i for p in got for i in np.frombuffer(p.ids, "<u4").tolist()) == want
    assert len({p.sequence_id for p in got}) > 1


def test_near_duplicates_awkward(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    near = [(100 + i, " ".join(words[:i] + ["edit"] + words[i:])) for i in range(30)]
    rows = AWKWARD + near + [(None, near[0][1]), (None, "lost and alone in the world"), (None, "lost and alone in the world"), (50, "tie tie tie")]
    df = docs(spark, rows, EXTRA + ("_place", "_print", "_fp", "_component", "_kept", "fp", "component", "row"))
    kept = keep_one_of_each(df)
    assert kept.schema == df.schema and all(r["_place"] == r["_fp"] == r["row"] == 7 for r in kept.collect())
    # ids stand for documents; rows without id are compared by their component
    prints = [(i, plain(t)) for i, t in rows]
    groups = components(prints)
    want = sorted({str(i) for (i, _), c in zip(prints, groups) if i is not None and i == c})
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got if r.doc_id is not None) == want
    lost = {p for (i, p), c in zip(prints, groups) if c is None}
    assert sorted(plain(r.text) for r in got if r.doc_id is None) == sorted(lost)
    assert keep_one_of_each(docs(spark, [], EXTRA)).collect() == []


def test_repeats_awkward(spark):
    rows = AWKWARD + corpus(3, 40) + [(None, "y" * 60), (900, "y" * 60), (901, "y" * 60 + "é" * 40), (902, "é" * 30 + "z")]
    df = docs(spark, rows, EXTRA)
    got = without_repeats(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.n_chars, r.source, r.score) for r in got.collect()) == sorted(
        (str(i), t, len(t), "s", 7) for i, t in cut(rows))
    assert without_repeats(docs(spark, [], EXTRA)).collect() == []


def test_mix_awkward(spark):
    rows = [(i, t, ("b", "a", None)[n % 3]) for n, (i, t) in enumerate(AWKWARD) if i != 10]
    df = docs(spark, rows, EXTRA)
    got = mixed_documents(df)
    assert got.columns == df.columns
    check_rows(spark, df, got.collect())
    for r in got.collect():  # what is taken stands in the text as it is
        assert r.text in dict((i, t) for i, t, _ in rows)[r.doc_id]
    assert mixed_documents(docs(spark, [], EXTRA)).collect() == []


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_packing_of_repeated_rows(spark):
    df = docs(spark, [(1, "a b c"), (1, "a b c"), (2, None)])
    pieces = cp.packing(spark, df.where("doc_id = 2"), SF_SMALL).collect()
    check_pack(pieces, [(2, None)], 2048)
    assert sum(p.length for p in cp.packing(spark, df, SF_SMALL).collect()) == 2 * len(ids_of("a b c")) + 1
