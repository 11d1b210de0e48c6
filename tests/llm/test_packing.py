"""Packing: an exact round trip of every document's ids."""

import zlib
from collections import defaultdict

import numpy as np
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.packing import _exact, balance, pack_documents


def ids_of(text):
    return [*_exact().encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, texts, window):
    """``texts``: (id, text) rows with distinct ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids, at = ids_of(text), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert list(np.frombuffer(p.ids, "<u4")) == ids[at:at + p.length]
            at += p.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0 and {p.sequence_tokens for p in rows} == {at}
        assert len({p.step_group for p in rows}) == 1


def test_round_trip(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    for partitions, window, shortest, block in ((1, 2048, 256, 1 << 21), (3, 2048, 256, 5000), (2, 64, 64, 100), (2, 512, 1, 3000)):
        out = pack_documents(table.repartition(partitions), window=window, shortest=shortest, block_tokens=block).collect()
        check(out, texts, window)


def test_query_digests(spark):
    got = queries.QUERIES["op3_packing"](spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for p in got:
        ids = ids_of(texts[p.doc_id])[p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(p.length for p in got) == sum(len(ids_of(t)) for t in texts.values())


def test_awkward(spark):
    rows = [r for r in AWKWARD if r[0] != 10]
    check(pack_documents(docs(spark, rows, EXTRA)).collect(), rows, 2048)
    twice = pack_documents(docs(spark, [(1, "a b c")] * 5)).collect()
    assert sum(p.length for p in twice) == 5 * len(ids_of("a b c"))
    assert pack_documents(docs(spark, [])).collect() == []


def test_steps_are_balanced():
    sizes = [2048] * 37 + [1024] * 20 + [256] * 100
    steps = balance(sizes, 16 * 2048)
    loads = defaultdict(int)
    for s, n in zip(steps, sizes):
        loads[s] += n
    assert max(loads.values()) - min(loads.values()) <= 2048
