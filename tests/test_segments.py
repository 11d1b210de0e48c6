"""Segments, tombstones and merges: any sequence of runs answers like an index built anew."""

import random

import pytest

from docsift.operators import fulltext as T
from docsift.operators import segments as SG

SCHEMA = "id long, name string, title string, path string, content string, extra int"
WORDS = ["red", "blue", "été", "Straße", "fox", "dog", "the", "of", "naïve", "x1"]


def document(rng, i):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    return (i, f"doc{i} {text(2)}", rng.choice([None, "", text(3)]), rng.choice(["", "a/red", "b"]), rng.choice([None, text(30), text(6)]), i % 7)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def answers(ix, docs):
    """Everything that a search asks of an index."""
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    return {
        "postings": rows(ix.postings.select("token", "id", "field", "tf", "dl", F_joined())),
        "all": rows(ix.bm25(["red", "fox"])), "any": rows(ix.bm25(["red", "ete", "gone"], require_all=False)),
        "fields": rows(ix.bm25(["red", "a"], fields=["title", "path"], require_all=False)),
        "phrase": rows(ix.phrase_scores(docs, ["the", "red"])), "twice": rows(ix.phrase_scores(docs, ["red", "red"], ["content"])),
        "prefix": rows(ix.prefix_scores("stras")), "fuzzy": rows(T.match_fuzzy_index(ix.grams, "naive", in_path=True)),
        "stats": rows(ix.stats), "df": rows(ix.document_frequency(["red", "of", "x1"], ["name", "content"])),
        "terms": rows(ix.terms()), "documents": rows(ix.documents.select(*docs.columns).withColumn("title", _text("title")).withColumn("content", _text("content"))),
    }


def F_joined():
    from pyspark.sql import functions as F

    return F.array_join(F.transform("pos", lambda p: p.cast("string")), ",").alias("places")


def _text(c):
    from pyspark.sql import functions as F

    return F.coalesce(c, F.lit("<null>"))


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_answer_like_a_new_index(spark, tmp_path, seed):
    rng = random.Random(seed)
    state = {i: document(rng, i) for i in range(40)}
    ix = SG.create_index(frame(spark, list(state.values())), str(tmp_path / "ix"), grams=True)
    after_first = dict(state)
    for run in range(4):
        changed = {i: document(rng, i) for i in rng.sample(range(60), 8 + 10 * (run == 2))}
        deleted = rng.sample(range(60), 6)
        ix = ix.upsert(frame(spark, list(changed.values())), spark.createDataFrame([(i,) for i in deleted], "id long"))
        state = {i: d for i, d in state.items() if i not in deleted} | changed
    docs = frame(spark, list(state.values()))
    fresh = answers(SG.create_index(docs, str(tmp_path / "fresh"), grams=True), docs)
    opened = SG.open_index(spark, str(tmp_path / "ix"))
    assert opened.version == ix.version and answers(opened, docs) == fresh
    compacted = ix.compact()
    assert len(compacted.segments) == 1 and answers(compacted, docs) == fresh
    # an earlier version still answers as it did
    old = SG.open_index(spark, str(tmp_path / "ix"), version=1)
    assert {r.id for r in old.documents.collect()} == set(after_first) and len(old.segments) == 1
    log = {r.version: r for r in SG.index_runs(spark, str(tmp_path / "ix")).collect()}
    assert log[compacted.version].n_docs == len(state)


def test_writes_follow_the_change(spark, tmp_path):
    rng = random.Random(5)
    ix = SG.create_index(frame(spark, [document(rng, i) for i in range(400)]), str(tmp_path / "ix"))
    whole = ix.segments[0].n_postings
    for run in range(6):
        ix = ix.upsert(frame(spark, [document(rng, 1000 + 5 * run + j) for j in range(5)]))
    log = SG.index_runs(spark, str(tmp_path / "ix")).orderBy("version").collect()
    assert log[0].written == whole
    assert sum(r.written for r in log[1:]) < whole / 2  # the large segment is never written again
    assert len(ix.segments) < 6 and any(s.segment.startswith("m") for s in ix.segments)


def test_delete_everything_and_come_back(spark, tmp_path):
    rng = random.Random(6)
    rows = [document(rng, i) for i in range(12)]
    ix = SG.create_index(frame(spark, rows), str(tmp_path / "ix"))
    ix = ix.upsert(deletes=spark.createDataFrame([(i,) for i in range(12)], "id long"))
    assert ix.segments == [] and ix.documents.collect() == [] and ix.bm25(["red"]).collect() == []
    ix = ix.upsert(frame(spark, rows[:3]))
    assert {r.id for r in ix.documents.collect()} == {0, 1, 2}
    assert ix.upsert(deletes=spark.createDataFrame([(99,)], "id long")).stats.first().n_docs == 3


def test_empty_index_and_odd_texts(spark, tmp_path):
    ix = SG.create_index(frame(spark, []), str(tmp_path / "ix"))
    assert ix.bm25(["red"]).collect() == [] and ix.stats.first().n_docs == 0
    ix = ix.upsert(frame(spark, [(1, None, None, None, None, 1), (2, "  ", "", "", "...", 2), (3, "w " * 5000, "", "", "w", 3)]))
    assert [(r.id, r.tf, r.dl, len(r.pos)) for r in ix.postings.where("field = 'name'").collect()] == [(3, 5000, 5001, 5000)]
    assert ix.stats.first().n_docs == 3


def test_row_counts_equal_a_group_by(spark):
    rng = random.Random(7)
    docs = frame(spark, [document(rng, i) for i in range(300)])
    got = SG.document_postings(docs)
    want = T.build_postings(docs)
    assert sorted(map(tuple, got.select("token", "id", "field", "tf").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("first").groupBy("token", "id").count().where("count > 1").isEmpty()
