"""Suffix-array dedup against a dictionary of all 50-byte strings."""

import hashlib
import random

import numpy as np
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm import suffix_dedup as sd
from docsift.llm.suffix_sort import BlindTrie, sort_suffixes


def brute(rows, span=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p:p + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p:p + span]] < i:
                    gone[p:p + span] = b"\1" * span
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def flat(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def corpus(seed, n, copy=0.6):
    """Texts that share pieces of random length with others, edited and joined."""
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            if texts and rnd.random() < copy:
                t = rnd.choice(texts)
                s = rnd.randint(0, max(0, len(t) - 1))
                parts.append(t[s:s + rnd.choice([20, 45, 49, 50, 51, 60, 100, 400])])
            else:
                parts.append("".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 200))))
        texts.append("".join(parts))
    ids = rnd.sample(range(10 * n), n)
    return list(zip(ids, texts))


def test_sort_suffixes():
    rng = np.random.default_rng(1)
    for n, depth, letters in ((500, 50, 2), (300, 30, 3), (200, 50, 200), (1, 50, 2)):
        text = rng.integers(0, letters, size=(n, depth)).astype(np.uint8)
        text[n // 2:, :40] = text[0, :40]
        group = rng.integers(0, 4, size=n).astype(np.uint64)
        order, common = sort_suffixes(group, text)
        want = sorted(range(n), key=lambda i: (group[i], text[i].tobytes()))
        assert [(group[i], text[i].tobytes()) for i in order] == [(group[i], text[i].tobytes()) for i in want]
        for a, b, c in zip(order, order[1:], common[1:]):
            if group[a] != group[b]:
                assert c == 0
            else:
                same = text[a] == text[b]
                assert c == (depth if same.all() else same.argmin())


def test_blind_trie_orders_any_strings():
    rnd = random.Random(2)
    for _ in range(200):
        items = [bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randint(1, 60))]
        trie = BlindTrie()
        for i, x in enumerate(items):
            trie.insert(x, i)
        assert [items[i] for i in trie.rows()] == sorted(items)


def test_anchors_cover_every_window():
    rng = np.random.default_rng(3)
    for data in (rng.integers(0, 4, 3000).astype(np.uint8), np.zeros(500, np.uint8), rng.integers(0, 255, 49).astype(np.uint8)):
        at, h = sd.text_anchors(data)
        hashes = sd._seed_hashes(data) if len(data) >= sd.SEED else np.zeros(0)
        for s in range(len(data) - sd.SPAN + 1):
            assert s + int(np.argmin(hashes[s:s + sd.BEFORE + 1])) in set(at.tolist())


def test_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    whole = sd.text_anchors(data)
    monkeypatch.setattr(sd, "SEGMENT", 700)
    parts = sd.text_anchors(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_shared_pieces(spark):
    for seed in (1, 2):
        rows = corpus(seed, 120)
        assert flat(sd.remove_repeats(docs(spark, rows), bucket_bytes=3000)) == brute(rows)


def test_many_copies_and_runs_of_one_byte(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = [(i, base) for i in range(60)] + [(100 + i, base[:i * 5] + "#" + base[i * 5:]) for i in range(60)]
    rows += [(300, "a" * 500), (301, "a" * 49), (302, "a" * 50), (303, "b" + "a" * 120 + "b")]
    rnd.shuffle(rows)
    assert flat(sd.remove_repeats(docs(spark, rows))) == brute(rows)


def test_awkward(spark):
    rows = AWKWARD + [(20, "y" * 60), (20, "y" * 60), (20, "z" * 70), (21, "z" * 70 + "y" * 55), (None, "y" * 60), (22, "日本語" * 40), (23, "本語日" * 40)]
    assert flat(sd.remove_repeats(docs(spark, rows, EXTRA))) == brute(rows)
    assert flat(sd.remove_repeats(docs(spark, []))) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op5_suffix_dedup"](spark, SF_SMALL).collect())
    assert got == brute(rows)
