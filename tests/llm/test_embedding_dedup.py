"""Embedding duplicates against a comparison of all pairs."""

import numpy as np

from conftest import SF_SMALL
from docsift.llm import embedding_dedup as ed
from docsift.llm import queries
from docsift.llm.vectors import cosines

SCHEMA = "vec_id long, embedding array<float>, label int, class_no int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    n, label = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                c = cosines(np.array([rows[i][1]], np.float32).astype(float), np.array([rows[j][1]], np.float32).astype(float))[0]
                if c >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i in range(n):
        c = min((x for x in groups[root(i)] if x is not None), default=None)
        out.append((str(rows[i][0]), links[i], str(c), rows[i][0] is not None and rows[i][0] == c))
    return sorted(out)


def flat(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def clusters(seed, sizes, dims=16, noise=0.15):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        c = rng.normal(size=dims)
        rows += [(c + noise * rng.normal(size=dims)).astype(np.float32).tolist() for _ in range(size)]
    return [(i, v) for i, v in enumerate(rows)]


def test_clusters_larger_than_the_window(spark):
    rows = clusters(1, [120, 40, 7, 2] + [1] * 150, noise=0.2)
    assert flat(ed.embedding_duplicates(frame(spark, rows), window=8)) == brute(rows)


def test_chunks_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(ed, "CHUNK", 16)
    rows = clusters(2, [150, 30], noise=0.2)
    assert flat(ed.embedding_duplicates(frame(spark, rows))) == brute(rows)


def test_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.001]), (4, None), (5, []), (6, [0.0, -0.0]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]),
            (12, [1e-30, 1e-30]), (13, [1e30, 1e30]), (None, None), (None, [0.0, 5.0]), (14, [0.0])]
    assert flat(ed.embedding_duplicates(frame(spark, rows))) == brute(rows)
    assert flat(ed.embedding_duplicates(frame(spark, []))) == []


def test_many_copies(spark):
    rows = [(i, [0.5, 0.25, 1.0]) for i in range(400)] + [(1000 + i, [0.5, 0.25, 1.0 + i / 5000]) for i in range(1, 60)]
    got = flat(ed.embedding_duplicates(frame(spark, rows)))
    assert got == brute(rows)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert flat(queries.QUERIES["op7_embedding_dedup"](spark, SF_SMALL)) == brute(rows)


def alike(seed, n=3000, dims=64, pairs=400, cosine=0.9005):
    """A third of the rows at mutual cosine 0.7, isolated pairs among them."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, c = unit(rng.normal(size=(n, dims))), unit(rng.normal(size=dims))
    x[:n // 3] = unit(np.sqrt(0.7) * c + np.sqrt(0.3) * unit(rng.normal(size=(n // 3, dims))))
    y = rng.normal(size=(pairs, dims))
    y = unit(y - (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    y = cosine * x[:pairs] + np.sqrt(1 - cosine ** 2) * y
    return np.concatenate([x, y]).astype(np.float32)


def test_recall_among_alike_vectors(spark):
    x = alike(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(1) - 1).sum()
    got = ed.embedding_duplicates(frame(spark, list(enumerate(x.tolist()))), window=8).collect()
    assert want >= 700 and 0.97 * want <= sum(r.n_links for r in got) <= want
