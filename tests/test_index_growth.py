"""Runs of a text index that stay cheap as it grows: postings are not shuffled to drop replaced documents, nor copied to be merged."""

import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import fulltext as T
from docsift.operators import runs as R
from docsift.operators import segments as SG
from docsift.session import short_rows

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SCHEMA = "segment string, id long, name string, content string"


@pytest.fixture
def no_broadcast(spark):
    """A session that broadcasts nothing by itself, as if all tables were large."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_token_counts_equal_those_of_the_postings(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["red", "été", "of", "Straße", "the"]) for _ in range(rng.randint(0, 6)))
    rows = [(rng.choice("ab"), i, rng.choice([None, "", text()]), text()) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = SG.document_postings(docs, ("name", "content"), keep=("segment",)).where("first").groupBy("segment", "token", "mask").agg(F.count("id").alias("n"))
    got = SG.token_counts(docs, ("name", "content")).select("segment", "token", "mask", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert SG.token_counts(docs.where("false"), ("name",)).isEmpty()


def test_replaced_documents_are_dropped_in_place(spark, tmp_path, no_broadcast, monkeypatch):
    docs = spark.range(600).selectExpr("id", "concat('w', id % 7, ' all') AS name")
    ix = SG.create_index(docs, str(tmp_path / "ix"), fields=("name",))
    ix = ix.upsert(docs.where("id < 50").selectExpr("id", "'new' AS name"), merge=False)
    for kind in ("postings", "docs"):  # a sort merge join of all postings before
        assert "Exchange hashpartitioning" not in ix.live(kind)._jdf.queryExecution().executedPlan().toString()
    kept = []
    monkeypatch.setattr(SG, "write_in_order", lambda *a, **b: (kept.append(b.get("keep", True)), T.write_in_order(*a, **b)))
    merged = ix.compact()
    assert kept == [False]  # copied to the executors' disks before
    assert len(merged.segments) == 1 and merged.documents.count() == 600
    assert {r.token: r.n for r in merged.terms().collect()}["all"] == 550
    monkeypatch.setattr(SG, "HELD_IDS", 10)  # too many to be held: the same rows by a shuffle
    other = SG.open_index(spark, str(tmp_path / "ix"), version=2)
    assert "Broadcast" not in other.live("postings")._jdf.queryExecution().executedPlan().toString()
    rows = lambda x: sorted(tuple(r) for r in x.postings.select("token", "id", "tf", "dl").collect())
    assert rows(other) == rows(merged) == rows(other.compact())
    assert kept == [False, True]


def test_bytes_of_short_rows_are_not_added_up(spark):
    before = spark.conf.get(BYTES)
    with short_rows(spark, 1000):
        assert int(spark.conf.get(BYTES).rstrip("b")) == (1 << 31) - 1
    assert spark.conf.get(BYTES) == before
    with short_rows(spark, 1 << 20):  # rows that may reach the bound keep it
        assert spark.conf.get(BYTES) == before
    with pytest.raises(ZeroDivisionError), short_rows(spark, 1):
        1 / 0
    assert spark.conf.get(BYTES) == before


def test_bounds_of_long_tokens(spark, tmp_path):
    long = "x" * (SG.SHORT + 1)
    docs = spark.range(200).selectExpr("id", f"concat('all ', if(id % 2 = 0, '{long}', 'y')) AS name")
    ix = SG.create_index(docs, str(tmp_path / "ix"), fields=("name",))
    found = ix.blocks(["all", long, "y"]).groupBy("token").agg(F.sum("n").alias("n"), F.count("block").alias("blocks")).collect()
    assert {r.token: (r.n, r.blocks) for r in found} == {"all": (200, 4), long: (100, 4), "y": (100, 4)}


def test_stored_grams_are_merged_in_packed_rows(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcdé 日\U0001F600") for _ in range(rng.randint(0, 60)))
    docs = spark.createDataFrame([(i, text(), rng.choice([None, text()])) for i in range(700)], "id long, name string, content string")
    want = T.trigram_postings(docs, ["content", "name"]).select("gram", "id", "field")
    fields = tuple(T.FUZZY_BOOSTS)
    for k in range(3):  # segments of any documents
        R.write_document_grams(docs.where(f"id % 3 = {k}"), str(tmp_path / f"g/segment={k}"), ("content", "name"), "id", 3)
    stored = spark.read.parquet(str(tmp_path / "g"))
    R.write_stored_grams(stored, str(tmp_path / "m"), fields, 6, 700)
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    files = sorted(got.groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("gram", "id")).alias("a"), F.max(F.struct("gram", "id")).alias("b"), F.collect_list(F.struct("gram", "id", "field")).alias("rows")).collect(), key=lambda x: x.a)
    assert len(files) > 2 and all(x.b < y.a for x, y in zip(files, files[1:]))
    assert all(x.rows == sorted(x.rows) for x in files)
    assert R.stored_gram_rows(stored.where("field = 'name'").orderBy("gram", "id"), fields, []).count() < got.count() / 10  # a row each before


def test_a_merge_moves_packed_grams(spark, tmp_path, monkeypatch):
    docs = spark.range(300).selectExpr("id", "concat('some words w', id % 9) AS name", "'' AS content", "'' AS path")
    ix = SG.create_index(docs, str(tmp_path / "ix"), fields=("name", "content"), grams=True).upsert(docs.where("id >= 290"), merge=False)
    ordered = []
    monkeypatch.setattr(SG, "write_in_order", lambda *a, **b: (ordered.append(a[1].split("/")[-2]), T.write_in_order(*a, **b)))
    merged = ix.compact()
    assert ordered == ["postings"]  # and "grams" before, a row for each of them
    rows = lambda df: sorted(map(tuple, df.select("gram", "id", "field").collect()))
    assert rows(merged.grams) == rows(T.trigram_postings(docs, ["name", "content"])) and len(merged.segments) == 1
