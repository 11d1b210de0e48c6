"""Spelling variants against plain edit distances over all pairs."""

import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.spelling import SortedWords, near_words, spelling_variants, word_counts
from llm_fixtures import AWKWARD, EXTRA, docs


def one_edit(a, b):
    """Differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def lower(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def brute_counts(rows, min_length=7, min_count=2, damage=31):
    n = {}
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if c >= min_count}


def brute(n, ratio=10):
    """Deletions give the candidates, a plain comparison decides."""
    parts = {}
    for w in n:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            parts.setdefault(v, set()).add(w)
    near = {w: {x for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for x in parts[v] if one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def typos(seed, words=60, letters="abcé", size=(7, 11)):
    rng = random.Random(seed)
    out = set()
    for _ in range(words):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*size)))
        out.add(w)
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            out.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]]) or "a")
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_scan_of_one_list(seed):
    words = typos(seed, letters="ab" if seed % 2 else "abcdefghé", size=(1, 9))
    a, b = SortedWords([w.encode("latin-1") for w in words], np.zeros(len(words), np.int64)).near()
    got = sorted(zip(a.tolist(), b.tolist()))
    assert got == sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_edit(x, y))


def test_groups_stay_apart():
    groups = [typos(s, words=5, size=(1, 5)) for s in range(30)] + [["aaaaaaa"]]
    flat = [(g, w) for g, ws in enumerate(groups) for w in ws]
    a, b = SortedWords([w.encode("latin-1") for _, w in flat], np.array([g for g, _ in flat])).near()
    want = sorted((i, j) for i, (g, x) in enumerate(flat) for j, (h, y) in enumerate(flat) if g == h and one_edit(x, y))
    assert sorted(zip(a.tolist(), b.tolist())) == want and want


@pytest.mark.parametrize("group_words", [1 << 16, 3])  # as it is; nearly every group dealt anew
def test_near_words(spark, group_words):
    words = typos(7) + typos(8, letters="ab", size=(7, 8)) + ["é" * 3000, "é" * 2999, "x" * 500]
    words = sorted({w for w in words if len(w) >= 6})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in near_words(df, min_length=6, group_words=group_words).collect()]
    want = [(x, y, j) for x in words for j, y in enumerate(words) if one_edit(x, y)]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_one_shared_start(spark):
    """A third of all words, and more, with one beginning."""
    rng = random.Random(9)
    words = sorted({"sharedstart" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(300)} | set(typos(3)))
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in near_words(df, min_length=6, group_words=50).collect()]
    assert sorted(got) == sorted((x, y, j) for x in words for j, y in enumerate(words) if one_edit(x, y))


def test_forms_follow_to_the_root(spark):
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 999, "aaabbbb": 1001, "ccccccc": 3, "cccccccc": 30, "ccccccd": 30, "eeeeeee": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = result(spelling_variants(df, ratio=10, min_length=7))
    assert got == brute(n)
    assert {r[0]: r[2] for r in got}["aaaaaaa"] == "aaaaabb" and {r[0]: r[1] for r in got}["ccccccc"] == "cccccccc"


def test_awkward_texts(spark):
    rows = AWKWARD + [(20, "Straße STRASSE Übermaß übermaß Übermaß résumés résumés resumés"), (None, "Straße straßen straßen résumés"),
                      (21, "a" * 70 + " " + "b" * 40000), (22, "b" * 40000 + " " + "a" * 70 + " " + "b" * 39999), (23, "b" * 39999),
                      (24, "÷wordword ×wordword ÷wordword×wordword")]
    rows += [(i, "beginning beginnings sentence sentense sentence") for i in range(100, 220)]
    frame = docs(spark, rows, EXTRA + ("word", "n", "h", "key", "id"))
    n = brute_counts(rows)
    assert {r.word: r.n for r in word_counts(frame).collect()} == n
    assert result(spelling_variants(word_counts(frame), min_length=7)) == brute(n)
    assert {r.word: r.n for r in word_counts(frame, damage=None, min_length=4).collect()} == brute_counts(rows, 4, 2, None)
    assert result(spelling_variants(word_counts(docs(spark, [])))) == []


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(brute_counts(rows))
    assert result(queries.QUERIES["op12_spelling"](spark, SF_SMALL)) == want and any(r[1] for r in want)
