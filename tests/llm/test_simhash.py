"""SimHash duplicates against a comparison of all pairs."""

import random

import numpy as np
import xxhash
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.common import words_of
from docsift.llm.components import connected_components
from docsift.llm.simhash import fingerprint_components, near_links, simhash_duplicates


def plain(text, shingle=4):
    words = words_of((text or "").encode())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, bits=4):
    """Rows (id, fp) -> component per row."""
    x = np.array([p for _, p in prints], dtype=np.uint64)
    label = list(range(len(x)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(x))]


def test_awkward(spark):
    got = simhash_duplicates(docs(spark, AWKWARD, EXTRA)).collect()
    prints = [(i, plain(t)) for i, t in AWKWARD]
    want = sorted(zip(map(str, (i for i, _ in prints)), (f"{p:016x}" for _, p in prints), map(str, components(prints))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash_duplicates(docs(spark, [])).collect() == []


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_simhash"](spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [(r.doc_id, plain(r.text)) for r in rows]
    for (i, p), c in zip(prints, components(prints)):
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == c


def clustered(seed, centres, members, flips):
    rnd = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(members):
            x = c
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            out.append(x)
    return [(i, x) for i, x in enumerate(out)]


def check(spark, prints, bits=4):
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in fingerprint_components(df, bits).collect()}
    assert [got[x] for _, x in signed] == components(prints, bits)


def test_clusters(spark):
    check(spark, clustered(1, 40, 30, 5) + [(5000 + i, x) for i, x in clustered(2, 300, 1, 0)])
    check(spark, clustered(3, 60, 12, 4), bits=3)


def test_long_runs_in_chunks(spark):
    # one first segment for all: its run holds every row and is cut into chunks
    rnd = random.Random(7)
    prints = [(i, rnd.getrandbits(42) << 22 | 12345) for i in range(900)] + [
        (900 + i, x & ~0x3FFFFF | 12345) for i, (_, x) in enumerate(clustered(5, 20, 20, 4))]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for _, x in prints], "fp long").distinct()
    plain_links, cut = near_links(nodes), near_links(nodes, run_max=64)
    want = {}
    for (i, x), c in zip(prints, components(prints)):
        want.setdefault(c, set()).add(x - (1 << 64) if x >> 63 else x)
    for links in (plain_links, cut):
        got = {}
        for r in connected_components(links).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1000 + i) for i in range(1, 2000)]
    pairs = [(5000 + rnd.randrange(400), 5000 + rnd.randrange(400)) for _ in range(150)]
    rows = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in chain + star + pairs]
    rnd.shuffle(rows)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()}
    label = {}

    def root(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in rows:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    linked = {x for a, b in rows if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
