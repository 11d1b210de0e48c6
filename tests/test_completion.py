"""The completion index: same rows as a scan of all values, and only a range is read."""

import random

from pyspark.sql import functions as F

from docsift.operators import completion as K
from docsift.operators.search import suggest_paths


def values(n=400):
    rng = random.Random(2)
    rows = ["/".join(rng.choice(["src", "Docs", "é", "a", "b1", "x_y", "100%"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return rows + ["", None, "a", "日本/語"]


def test_same_rows_as_a_scan(spark, tmp_path):
    df = spark.createDataFrame([(v,) for v in values()], "path string")
    index = K.write_completions(df, str(tmp_path / "k"), "path")
    scan = df.where("path IS NOT NULL").distinct()
    for text in ["src/", "s", "", "docs", "OCS/", "1", "b1/é", "100%", "_", "nothing at all", "日", "Src/a"]:
        want = [r.path for r in suggest_paths(scan, text).collect()]
        assert [r.value for r in index.suggest_paths(text).collect()] == want, text
        assert [r.value for r in index.suggest_paths(text, 3).collect()] == want[:3]
    counted = {r.path: r["count"] for r in df.where("path LIKE 'src%'").groupBy("path").count().collect()}
    best = [(r.value, r.weight) for r in index.suggest("src", by_weight=True).collect()]
    assert dict(best) == counted and [w for _, w in best] == sorted(counted.values(), reverse=True)


def test_only_the_range_is_read(spark, tmp_path, monkeypatch):
    """The filters reach the files, and few of their row groups are touched."""
    monkeypatch.setattr(K, "ROW_GROUP", 4096)
    df = spark.range(40_000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("/tail")).alias("path"))
    index = K.write_completions(df, str(tmp_path / "k"), "path")
    plan = index.starting("p0123")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(value,p0123)" in plan
    grams = index.containing("0123")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,012)" in grams
    assert index.starting("p0123").count() == 100

    import pyarrow.parquet as pq

    groups = touched = 0
    for file in (tmp_path / "k" / "values").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "value")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            groups += 1
            touched += stats.min <= "p0124" and stats.max >= "p0123"
    assert groups > 10 and touched <= groups / 5
