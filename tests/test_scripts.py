"""Scripts on records: set, remove, get; tags and the index follow."""

from pyspark.sql import functions as F

from docsift.operators import scripts as X


def record(spark, js):
    return spark.createDataFrame([(1, js)], "id long, js string").select("id", F.parse_json("js").alias("record"))


def after(df, col):
    return df.select(col.cast("string").alias("v")).first().v


def test_set_remove_get(spark):
    df = record(spark, '{"a": 1, "b": {"c": "x", "d": [1, 2]}, "e": null}')
    assert after(df, X.set_key("record", "a", F.lit("new"))) == '{"a":"new","b":{"c":"x","d":[1,2]},"e":null}'
    assert after(df, X.set_key("record", "b.c", F.lit(2.5))) == '{"a":1,"b":{"c":2.5,"d":[1,2]},"e":null}'
    assert after(df, X.set_key("record", "z.y.x", F.lit(True))) == '{"a":1,"b":{"c":"x","d":[1,2]},"e":null,"z":{"y":{"x":true}}}'
    assert after(df, X.set_key("record", "a.b", F.array(F.lit(1)))) == '{"a":{"b":[1]},"b":{"c":"x","d":[1,2]},"e":null}'
    assert after(df, X.remove_key("record", "b")) == '{"a":1,"e":null}'
    assert after(df, X.remove_key("record", "b.d")) == '{"a":1,"b":{"c":"x"},"e":null}'
    assert after(df, X.remove_key("record", "nothing.there")) == '{"a":1,"b":{"c":"x","d":[1,2]},"e":null}'
    got = df.select(X.get_key("record", "b.c").alias("c"), X.get_key("record", "b.d", "array<long>").alias("d"),
                    X.get_key("record", "b.c", "long").alias("not_long"), X.get_key("record", "e").alias("e"), X.get_key("record", "f").alias("f")).first()
    assert tuple(got) == ("x", [1, 2], None, None, None)
    assert after(record(spark, "[1]"), X.set_key("record", "a", F.lit(1))) == '{"a":1}'


def test_tags_and_changes(spark):
    docs = spark.createDataFrame([(1, "one", 5), (2, "two", None), (3, "three", 7)], "id long, name string, size long")
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (9, "stray")], "id long, tag string")
    records = X.as_records(docs, tags)
    assert {r.id: r.v for r in records.select("id", F.col("record").cast("string").alias("v")).collect()} == {
        1: '{"name":"one","size":5,"tag":["a","b"]}', 2: '{"name":"two"}', 3: '{"name":"three","size":7}'}

    def script(rows):
        named = X.set_key("record", "name", F.upper(X.get_key("record", "name")))
        out = rows.where("id < 3").select("id", X.add_tags(named, F.array(F.lit("a"), F.lit("new.#123456"))).alias("record"))
        same = rows.where("id = 3")
        return out.unionByName(same).unionByName(rows.limit(1).select(F.lit(77).cast("long").alias("id"), "record"))

    rows, changed = X.run_script(records, script)
    assert sorted(r.id for r in changed.collect()) == [1, 2] and rows.count() == 3
    assert sorted(map(tuple, X.record_tags(rows).collect())) == [(1, "a"), (1, "b"), (1, "new.#123456"), (2, "a"), (2, "new.#123456")]
    back = {r.id: tuple(r) for r in X.as_documents(rows, docs).collect()}
    assert back == {1: (1, "ONE", 5), 2: (2, "TWO", None), 3: (3, "three", 7)}
    assert X.run_script(records, lambda r: r)[1].isEmpty()


def test_an_index_takes_changed_records_up(spark, tmp_path):
    from docsift.operators.indexer import SearchIndex, build_index
    from docsift.operators.search import SearchRequest
    from docsift.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    corpus, tags = fx.corpus.where("id < 40"), fx.tags.where("id < 40")
    ix = build_index(corpus, str(tmp_path / "ix"), fx.mime, tags, fx.emb.where("id < 40"))

    def script(rows):
        some = X.get_key("record", "size", "long") % 3 == 0
        named = X.set_key("record", "title", F.lit("Zebrafish report"))
        return rows.where(some).select("id", X.add_tags(named, F.array(F.lit("seen.#00ff00"))).alias("record"))

    want = {r.id for r in corpus.where("size % 3 = 0").collect()}
    before = ix.tags.count()
    done = ix.apply_script(script, fx.mime)
    for now in (done, SearchIndex(spark, str(tmp_path / "ix"))):
        page, totals = now.search(SearchRequest(terms=["zebrafish"], page_size=100, fetch_aggregations=True), columns=["id"])
        assert {r.id for r in page.collect()} == want and totals.first().total_count == len(want)
        assert {r.id for r in now.tags.where("tag = 'seen.#00ff00'").collect()} == want
        assert now.tags.where("tag <> 'seen.#00ff00'").distinct().count() == tags.distinct().count()
        assert now.documents.count() == corpus.count()
    assert done.text.version > ix.text.version and before == ix.tags.count()
