"""Building the stored index: 3-grams cut as numbers, rows computed once, bounds of blocks without a shuffle."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docsift.functions.text import trigrams
from docsift.operators import fulltext as T
from docsift.operators import segments as SG

TEXTS = [None, "", "ab", "abc", "aaaa", "Straße été ÆØ", "x\ny\tz", "\U0001F600\U0001F601\U0001F600\U0001F601", "İstanbul ΣΑΣ", "ab" * 4000, "no\u0000null"]


def test_trigrams_equal_the_expression(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(TEXTS)) for i, t in enumerate(TEXTS * 3 + ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(40)])]
    docs = spark.createDataFrame(rows, "id long, content string, name string")
    want = {(r.id, f, r.gram) for f in ("content", "name") for r in docs.select("id", F.explode(trigrams(f)).alias("gram")).collect()}
    got = [(r.id, r.field, r.gram) for r in T.trigram_postings(docs, ["content", "name"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_letters_in_a_run():
    # more letters than fit three to a number with the row
    texts = ["".join(chr(c) for c in range(0x4E00 + i, 0x9F00 + i)) + "abcabc" for i in range(3)] * 400
    few = T.distinct_grams(pa.array(texts[:3]))
    row, gram, strings = T.distinct_grams(pa.array(texts))
    for r, g, s, t in ((*few, texts[:3]), (row, gram, strings, texts)):
        names = s.to_pylist()
        of = [set() for _ in t[:3]]
        for a, b in zip(r.tolist(), g.tolist()):
            if a < 3:
                assert names[b] not in of[a]
                of[a].add(names[b])
        assert of == [{x[i:i + 3] for i in range(len(x) - 2)} for x in t[:3]]


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(5000).selectExpr("concat('t', id % 7) AS token", "id").mapInArrow(look, "token string, id long")
    T.write_postings(rows, str(tmp_path / "p"), 4)
    assert seen.value == 5000
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5000


def test_blocks_without_a_shuffle(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 30)))) for i in range(700)], "id long, name string")
    ix = SG.create_index(docs, str(tmp_path / "ix"), fields=("name",))
    rows = ix.postings.where("first")
    f = F.col("weighted")
    mean = ix.segments[0].total / ix.segments[0].n_docs
    ratio = f / (f + 1.2 * 0.25 + 1.2 * 0.75 / mean * F.col("dl"))
    want = rows.groupBy("token", F.floor(F.col("id") / SG.BLOCK).cast("long").alias("block")).agg(F.max(ratio).alias("most"), F.count("id").alias("n"))
    key = lambda df: sorted((r.token, r.block, round(r.most, 12), r.n) for r in df.collect())
    assert key(ix.blocks(list("abcdefg"))) == key(want)
    assert "Exchange" not in SG.score_blocks(ix.postings, mean)._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_token_share_a_row(spark, tmp_path):
    docs = spark.range(20_000).select("id", F.concat(F.lit("word w"), (F.col("id") % 5).cast("string")).alias("name"))
    ix = SG.create_index(docs, str(tmp_path / "ix"), fields=("name",))
    blocks = ix.blocks(["word", "w1"])
    assert blocks.where("token = 'word'").agg(F.count("block"), F.sum("n")).first() == (313, 20_000)
    assert blocks.where("token = 'w1'").agg(F.count("block"), F.sum("n")).first() == (313, 4_000)
    # 6 x 313 rows before
    assert spark.read.parquet(str(tmp_path / "ix" / "blocks")).count() < 100
