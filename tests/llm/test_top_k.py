"""Branch and bound against all inner products."""

import math

import numpy as np
from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.top_k import VerticalShard, exact_top_k

SCHEMA = "vec_id long, embedding array<double>, rank int, score string, shard int, dims int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "y") for i, v in rows], SCHEMA)


def brute(rows, asked, k=5, scale=256):
    x = sorted({(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows
                if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for q, v in x:
        if asked(q):
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_skips_and_is_exact():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 64)) * np.linspace(300, 5, 64)).astype(np.int64)
    x[::9] = x[0]
    shard = VerticalShard(np.arange(4000), x)
    at, row, score = shard.search(x[::50], np.arange(0, 4000, 50), 5)
    every = x[::50] @ x.T
    for i, q in enumerate(range(0, 4000, 50)):
        every[i, q] = -2**62
        order = sorted(range(4000), key=lambda j: (-every[i, j], j))[:5]
        assert row[at == i].tolist() == order and (score[at == i] == every[i, order]).all()
    assert shard.done < 0.6 * every.size * 64


def test_types_agree():
    rng = np.random.default_rng(2)
    for size in (3, 2**14, 2**26):
        x = rng.integers(-size, size, (500, 12))
        at, row, score = VerticalShard(np.arange(500), x, block_dims=5).search(x[:7], np.arange(7), 3)
        for i in range(7):
            full = {j: sum(int(a) * int(b) for a, b in zip(x[i], x[j])) for j in range(500) if j != i}
            want = sorted(full.items(), key=lambda p: (-p[1], p[0]))[:3]
            assert list(zip(row[at == i].tolist(), score[at == i].tolist())) == want


def test_many_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(700)]
    df = frame(spark, rows)
    got = exact_top_k(df, df.where("vec_id % 20 = 0"), k=4, shard_rows=90, group_rows=10, block_rows=3)
    assert result(got) == brute(rows, lambda q: q % 20 == 0, k=4)


def test_awkward(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 130)] + [(50, [1.0, 2.0, 3.0]), (200, None), (250, []), (251, []), (300, [0.0, 0.0, 0.0]),
            (350, [float("nan"), 1.0, 1.0]), (400, [None, 1.0, 1.0]), (None, [1.0, 2.0, 3.1]), (450, [3.0, -2.0, 1.0]), (450, [3.0, 2.0, 1.5]),
            (500, [1.0, 1.0]), (550, [float("inf"), 0.0, 0.0]), (600, [2.0**19, -2.0**19, 1.0]), (601, [-2.0**20, 3.0, 1.0])]
    df = frame(spark, rows)
    assert result(exact_top_k(df, df.where("vec_id % 50 = 0"))) == brute(rows, lambda q: q % 50 == 0)
    assert result(exact_top_k(frame(spark, []), frame(spark, []))) == []
    assert result(exact_top_k(df, frame(spark, []))) == []
    few = frame(spark, rows[:3])
    assert result(exact_top_k(few, few.where("vec_id = 0"))) == brute(rows[:3], lambda q: q == 0)


def test_query_against_sql(spark, duck):
    got = queries.QUERIES["op13_top_k"](spark, SF_SMALL)
    want = duck.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op13_top_k']})").fetchall()
    assert result(got) == sorted(want) and len(want) == 50
