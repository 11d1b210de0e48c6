"""Vantage-point trees against brute force: exact at factor one, recall else."""

import numpy as np

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.vectors import cosines
from docsift.llm.vp_tree import VantageTree, nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, asked, k=5):
    ok = sorted({(i, tuple(np.float32(c) for c in v)) for i, v in rows
                 if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for q, v in ok:
        if asked(q):
            best = {}
            for i, w in ok:
                if i != q and len(w) == len(v):
                    s = cosines(np.array([w], dtype=float), np.array([v], dtype=float))[0]
                    best[i] = max(best.get(i, -2), s)
            out[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_factor_one_is_exact():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(700, 6)), np.repeat(rng.normal(size=(1, 6)), 200, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = VantageTree(x, 3, leaf=10)
    best, rows = tree.search(x[::13], 6, 1.0, 8)
    want = np.sort(x[::13] @ x.T, axis=1)[:, ::-1][:, :6]
    assert np.allclose(best[:, :6], want)
    few = tree.search(x[::13], 6, 0.01, 8)[0]
    assert np.isfinite(few[:, 0]).all() and (few[:, :6] <= best[:, :6] + 1e-12).all()  # its own leaf at least


def test_many_shards_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    df = frame(spark, rows)
    got = nearest_vectors(df, df.where("vec_id % 50 = 0"), factor=1.0, shard_rows=100, block_rows=5)
    assert found(got) == brute(rows, lambda q: q % 50 == 0)


def test_awkward(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 130)] + [(50, same), (200, None), (250, []), (300, [0.0, 0.0, 0.0]), (350, [float("nan"), 1.0, 1.0]),
            (400, [None, 1.0, 1.0]), (None, [1.0, 2.0, 3.1]), (450, [3.0, 2.0, 1.0]), (451, [3.0, 2.0, 1.5]), (500, [1.0, 1.0])]
    df = frame(spark, rows)
    got = nearest_vectors(df, df.where("vec_id % 50 = 0"), factor=1.0)
    want = brute(rows, lambda q: q % 50 == 0)
    assert found(got) == {q: v for q, v in want.items() if v}
    assert nearest_vectors(frame(spark, []), frame(spark, [])).collect() == []
    few = frame(spark, rows[:1] + rows[-3:-1])
    assert found(nearest_vectors(few, few.where("vec_id = 0"), factor=1.0)) == {0: [451, 450]}


def test_ties_go_to_the_smaller_id(spark):
    """Far more tied vectors than the search keeps: multiples of one vector,
    and different directions with one and the same cosine."""
    rows = [(i, [0.25 * (1 + (i * 37) % 60), -0.5 * (1 + (i * 37) % 60), 0.125 * (1 + (i * 37) % 60)]) for i in range(60)]
    df = frame(spark, rows).repartition(7)
    got = found(nearest_vectors(df, df.where("vec_id % 50 = 0"), factor=0.2, shard_rows=7))
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    rng = np.random.default_rng(5)
    ring = [(100 + int(i), [1.0 if j == n % 40 else 0.0 for j in range(40)] + [1.0]) for n, i in enumerate(rng.permutation(40))]
    ring += [(50, [0.0] * 40 + [1.0])]
    df = frame(spark, ring).repartition(5)
    for shard_rows in (8192, 20):
        assert found(nearest_vectors(df, df.where("vec_id = 50"), factor=1.0, shard_rows=shard_rows)) == {50: [100, 101, 102, 103, 104]}
    # an id with more vectors than are kept beyond the wanted ones
    own = [(50, [1.0, 0.001 * j]) for j in range(30)] + [(i, [1.0, -0.1 * i]) for i in range(1, 8)]
    df = frame(spark, own)
    assert set(found(nearest_vectors(df, df.where("vec_id = 50").limit(1), factor=1.0))[50]) == {1, 2, 3, 4, 5}


def test_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = queries.QUERIES["op4_vp_tree"](spark, SF_SMALL)
    by_id = dict(rows)
    for r in got.collect():
        a, b = (np.array([by_id[i]], dtype=float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - cosines(a, b)[0]) < 1e-12
    want, near = brute(rows, lambda q: q % 50 == 0), found(got)
    assert near.keys() == want.keys() and all(len(v) == 5 for v in near.values())
    assert np.mean([len(set(near[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_recall_of_the_factor():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = VantageTree(x, 1).search(x[::50], 6, 0.2, 6)[1]
    want = np.argsort(-(x[::50] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(rows, want)]) >= 0.95
