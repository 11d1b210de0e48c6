"""Mixing: apportionment against a listing of all quotients, targets against
the iterative rule."""

import heapq
import random
from collections import defaultdict

import pytest
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.common import table, words_of
from docsift.llm.mixing import mix_sources, sainte_lague


def naive(weights, seats):
    won, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """``sizes`` in source order; excess reshared until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full, out = set(), [0.0] * len(sizes)
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in full)
        free = sum(w[i] for i in range(len(sizes)) if i not in full)
        if not free:
            return [most * s for s in sizes]
        out = [most * sizes[i] if i in full else left * w[i] / free for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and out[i] >= most * sizes[i]}
        if not over:
            return out
        full |= over


def test_quotas_equal_highest_quotients(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for g in range(60):
        n, seats = rnd.randint(1, 12), rnd.choice([0, 1, 7, 100, 1000])
        weights = [rnd.choice([0, 1, 1, 5, rnd.randint(1, 1000), rnd.random() * 10]) for _ in range(n)]
        rows += [(g, i, float(x), seats) for i, x in enumerate(weights)]
        want |= {(g, i): q for i, q in enumerate(naive(weights, seats))}
    df = spark.createDataFrame(rows, "g long, i long, w double, seats long")
    got = {(r.g, r.i): r.quota for r in sainte_lague(df, ["g"], ["i"], "w", "seats", "quota").collect()}
    assert got == want


def check(rows, texts, block=4):
    size = lambda t: len(words_of((t or "").encode()))
    by_source = defaultdict(int)
    for _, t, s in texts:
        by_source[s] += size(t)
    order = sorted(by_source, key=lambda s: (s is None, s.encode() if s else b""))
    want = dict(zip(order, targets([by_source[s] for s in order])))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), size(t)) for i, t, _ in texts)
    source = {i: s for i, _, s in texts}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by_source[s]
        assert r.target == pytest.approx(want[s])
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= block * (len(order) / 2 + 2)


def test_awkward(spark):
    texts = [(i, t, ("b", "a", None, "é", "z")[n % 5]) for n, (i, t) in enumerate(AWKWARD) if i != 10]
    df = docs(spark, texts, tuple(e for e in EXTRA))
    rows = mix_sources(df).collect()
    check(rows, texts)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(df.repartition(3)).collect()))
    assert mix_sources(docs(spark, [])).collect() == []
    assert [r.taken for r in mix_sources(docs(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_many_shards(spark):
    df = table(spark, SF_SMALL, "documents")
    texts = [(r.doc_id, r.text, r.source) for r in df.collect()]
    check(mix_sources(df, shard_words=500).collect(), texts)
    one = mix_sources(docs(spark, [(i, "a b c d e f g", "hot") for i in range(3000)] + [(5000, "x " * 9000, "big")]), shard_words=64)
    check(one.collect(), [(i, "a b c d e f g", "hot") for i in range(3000)] + [(5000, "x " * 9000, "big")])


def test_query(spark, duck):
    got = queries.QUERIES["op1_mixing"](spark, SF_SMALL).collect()
    texts = [(r.doc_id, r.text, r.source) for r in table(spark, SF_SMALL, "documents").collect()]
    check(got, texts)
    want = duck.sql(queries.ORACLES["op1_mixing"])
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
