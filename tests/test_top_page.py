"""Pages by score bounds equal those of a full scoring, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import segments as SG
from docsift.operators import top_page as TP
from docsift.operators.search import SCORE_PLACES, TEXT_FIELDS_NO_PATH

SCHEMA = "id long, name string, title string, path string, content string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Common words everywhere, and a few blocks where they stand close; three
    segments, some tombstones."""
    rng = random.Random(1)

    def row(i):
        few = ["red"] * rng.choice([1, 1, 2]) + ["fox"] * rng.choice([0, 1, 1]) + ["word"] * rng.randint(20, 60)
        if 1500 <= i < 1560:
            few = ["red"] * rng.randint(3, 9) + ["fox"] * rng.randint(2, 5) + ["word"] * 3
        return (i, f"n{i}", "red" if i == 2222 else "", "a/b", " ".join(few + (["rare"] if i % 701 == 0 else [])))

    path = str(tmp_path_factory.mktemp("top"))
    ix = SG.create_index(spark.createDataFrame([row(i) for i in range(6000)], SCHEMA), path)
    ix = ix.upsert(spark.createDataFrame([row(i) for i in range(6000, 6400)], SCHEMA), spark.createDataFrame([(1501,), (5,)], "id long"))
    return ix.upsert(spark.createDataFrame([row(i) for i in range(0, 400, 7)], SCHEMA))


def full(ix, terms, k, require_all, fields, among=None, after=None):
    rows = ix.bm25(terms, require_all=require_all, fields=fields)
    if among is not None:
        rows = rows.join(among, "id", "left_semi")
    out = sorted((-round(r.score, SCORE_PLACES), r.id) for r in rows.collect())
    if after is not None:
        out = [x for x in out if x > (-after[0], after[1])]
    return [(i, -s) for s, i in out[:k]]


def page(found):
    rows = found.scores.select("id", F.round("score", SCORE_PLACES).alias("s")).collect()
    return sorted(((r.id, r.s) for r in rows), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("terms", [["red", "fox"], ["red"], ["fox", "rare"], ["word"], ["red", "none"]])
@pytest.mark.parametrize("require_all", [True, False])
def test_same_page_as_full_scoring(spark, index, terms, require_all):
    for fields in (None, TEXT_FIELDS_NO_PATH, ["title"]):
        found = TP.top_scores(index, terms, 10, require_all, fields)
        assert page(found) == full(index, terms, 10, require_all, fields)
        assert found.pairs_read <= found.pairs and found.blocks_read <= found.blocks


def test_reads_less_for_common_words(index):
    found = TP.top_scores(index, ["red", "fox"], 10)
    assert found.blocks > 45 and found.blocks_read <= 40 and found.pairs_read < 0.8 * found.pairs


def test_next_pages_and_filters(spark, index, monkeypatch):
    monkeypatch.setattr(TP, "FIRST_BLOCKS", 2)
    odd = index.documents.where("id % 2 = 1").select("id")
    after, seen = None, []
    for _ in range(4):
        found = page(TP.top_scores(index, ["red", "fox"], 25, after=after, among=odd))
        assert found == full(index, ["red", "fox"], 25, True, None, odd, after)
        seen += [i for i, _ in found]
        after = (found[-1][1], found[-1][0])
    assert len(set(seen)) == 100 and all(i % 2 for i in seen)
    monkeypatch.setattr(TP, "MOST_RANGES", 3)
    assert page(TP.top_scores(index, ["red", "fox"], 50)) == full(index, ["red", "fox"], 50, True, None)
    few = spark.createDataFrame([(7,), (4001,)], "id long")
    assert page(TP.top_scores(index, ["red"], 50, among=few)) == full(index, ["red"], 50, True, None, few)
