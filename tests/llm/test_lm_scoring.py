"""Language-model scores: unigram part against brute force, model against a
plain computation, held-out gain over the unigram score."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import mixing_model as mm
from docsift.llm import queries
from docsift.llm.common import words_of
from docsift.llm.lm_scoring import score_language, word_hashes


def base_rows(rows):
    rem = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    counts, texts = Counter(), [(i, words_of((t or "").encode()) + [None]) for i, t in rows]
    for i, w in texts:
        if rem(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(str(i), rem(i) == 0, len(w), sum(counts[x] > 0 for x in w), n,
             sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in texts]


def compare(got, rows):
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(base_rows(rows), key=lambda r: (r[0], r[2], r[5]))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) <= 1e-9 * max(1, abs(w[5]))
        assert r.score <= 0 and math.isfinite(r.score)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op2_lm_scoring"](spark, SF_SMALL).collect()
    compare(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in score_language(spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(7)).collect()}
    assert all(abs(again[r.doc_id] - r.score) <= 1e-6 * abs(r.score) for r in got)


def test_awkward(spark):
    compare(score_language(docs(spark, AWKWARD, EXTRA), bucket_bytes=1000).collect(), AWKWARD)
    assert score_language(docs(spark, [])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    compare(score_language(docs(spark, [(held, "no training at all")])).collect(), [(held, "no training at all")])


def test_word_hashes_tell_words_apart():
    texts = [b"", b" \t ", b"The the THE then", b"ab ba a b aab", "é\u0085x é".encode(), b"w" * 5000 + b" " + b"w" * 5001]
    hashes, sizes = word_hashes(texts)
    words = [words_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len({(a, b) for a, b in zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))
    assert word_hashes([b"then the"])[0].tolist() == [hashes[flat.index(b"then")], hashes[flat.index(b"the")]]  # in any chunk
    assert word_hashes([b" ", b""])[1].tolist() == [0, 0] and word_hashes([])[1].tolist() == []


def code_of(texts, most=5):
    flat = np.zeros(mm.SYMBOLS << 16, dtype=np.uint32)
    mm.pair_counts(texts, flat)
    by_pair = flat.reshape(1 << 16, -1).astype(np.int64)
    total = by_pair.sum(1)
    common = [int(p) for p in np.lexsort((np.arange(1 << 16), -total))[:most] if total[p]]
    return mm.huffman_code(by_pair.reshape(256, 256, -1).sum(1), {p: by_pair[p] for p in common})


TEXTS = [b"", b"a", b"The cat sat on the mat.\nThe dog sat. " * 20, bytes(range(256)), "héé 日本".encode() * 9, b"x" * 9000]
NEW = b"The mat sat on the dog, zzz unseen. " * 30


def nodes(code, text):
    """Per place of a text: its decisions as (place in the code, nodes of all contexts, bit)."""
    block = mm.layout([text])
    assert block.symbol[:len(text)].tolist() == list(text.translate(mm.LOWER_BYTES)) and block.symbol[len(text)] == mm.END
    rows, hashes = mm.code_symbols(code, block), [mm._hashed(block, i) >> np.uint64(21) for i in range(mm.HASHED)]
    for place in np.flatnonzero(block.valid):
        r = int(rows[place])
        yield [(at, [(i, int(h[place]), r // mm.SYMBOLS, int(code.item[at]) & (1 << 31) - 1) for i, h in enumerate(hashes)],
                int(code.item[at]) >> 31) for at in range(code.start[r], code.start[r] + code.length[r])]


def plain_counts(code, texts):
    seen = [Counter(), Counter()]
    for text in texts:
        for place in nodes(code, text):
            for _, contexts, bit in place:
                seen[bit].update(contexts)
    return seen


def prediction(seen, node, bit):
    zeros, ones = seen[0][node], seen[1][node]
    if not zeros + ones:
        return 0
    x = int(np.clip(np.rint(math.log((ones + mm.PRIOR) / (zeros + mm.PRIOR)) * mm.SCALE), -mm.LIMIT, mm.LIMIT)) or 1
    return x if bit else -x


def plain_bits(code, seen, text, start):
    """One text, decision by decision."""
    places, bits = list(nodes(code, text)), 0.0
    for lane in range(0, len(places), mm.LANE):
        w = np.zeros(mm.INPUTS)
        for step in range(lane, min(lane + mm.LANE, len(places)), mm.STEP):
            grad = np.zeros(mm.INPUTS)
            for decisions in places[step:min(step + mm.STEP, lane + mm.LANE)]:
                for at, contexts, bit in decisions:
                    raw = [int(code.guess[at])] + [prediction(seen, c, bit) for c in contexts]
                    x = np.array(raw, dtype=float) / mm.SCALE
                    gate = (raw[1] != 0) + 2 * (raw[2] != 0)
                    p = 1 / (1 + math.exp(-float((start[gate] + w) @ x)))
                    bits -= math.log2(p)
                    grad += (1 - p) * x
            w += mm.RATE * grad
    return bits


def test_code_is_a_code():
    code = code_of(TEXTS)
    for row in (0, ord("t"), 256):
        words = set()
        for s in range(mm.SYMBOLS):
            at = row * mm.SYMBOLS + s
            words.add(tuple((code.item[code.start[at]:code.start[at] + code.length[at]] >> 31).tolist()))
        assert len(words) == mm.SYMBOLS and abs(sum(2.0 ** -len(w) for w in words) - 1) < 1e-9


@pytest.mark.parametrize("part", [mm.PART, 100])
def test_keys_and_predictions_equal_counts_by_context(monkeypatch, part):
    monkeypatch.setattr(mm, "PART", part)
    code = code_of(TEXTS)
    keys, counts = mm.count_keys(code, [(TEXTS, True), ([NEW], False)])
    assert counts.sum() == mm.HASHED * sum(len(t) + 1 for t in TEXTS) and (keys[1:] > keys[:-1]).all()
    ranks = []
    for i in range(mm.HASHED):
        distinct, rank = mm.key_ranks(code, [TEXTS[:3], TEXTS[3:], [NEW]], i)
        want = [mm.context_keys(code, b, i)[b.valid] for b in (mm.layout(TEXTS), mm.layout([NEW]))]
        assert (distinct[rank] == np.concatenate(want)).all() and len(np.unique(distinct)) == len(distinct)
        assert (np.diff(np.unique(rank, return_index=True)[1]) > 0).all()  # in the order of the text
        ranks.append(np.searchsorted(keys, distinct)[rank])
        assert (keys[ranks[i]] == distinct[rank]).all()
    values, length = mm.path_predictions(code, keys, counts), mm.key_lengths(code, keys)
    start, seen = np.cumsum(length) - length, plain_counts(code, TEXTS)
    at = 0
    for text in [*TEXTS, NEW]:
        for decisions in nodes(code, text):
            for i in range(mm.HASHED):
                path = values[start[ranks[i][at]]:][:len(decisions)]
                assert path.tolist() == [prediction(seen, contexts[i], bit) for _, contexts, bit in decisions]
            at += 1
    assert (values == 0).any()


def test_scores_equal_a_plain_computation():
    code = code_of(TEXTS)
    seen, start = plain_counts(code, TEXTS[:5]), mm.start_weights()
    keys, counts = mm.count_keys(code, [(TEXTS[:5], True), ([TEXTS[5], NEW], False)])
    totals = dict(zip(keys.tolist(), counts.tolist()))

    def predict(asked):
        values, length = mm.path_predictions(code, keys, counts), mm.key_lengths(code, keys)
        begin = (np.cumsum(length) - length)[np.searchsorted(keys, asked)]
        assert all(k in totals for k in asked.tolist())
        return values[mm.runs_of(begin, mm.key_lengths(code, asked))]

    texts = [[*TEXTS[:3]], [], [*TEXTS[3:], NEW]]
    got = mm.score_texts(code, texts, predict, start)
    for text, bits in zip(sum(texts, []), got):
        assert abs(plain_bits(code, seen, text, start) - bits) <= 1e-3 * max(1, bits)
        alone = mm.score_texts(code, [[text]], predict, start)[0]
        assert abs(alone - bits) <= 1e-5 * max(1, bits)
    assert len(mm.score_texts(code, [], predict, start)) == 0


def test_query_score_equals_a_plain_model(spark):
    """The whole operator against the model written out: the fold, the code
    and counts of all training texts, chunks and buckets of any size."""
    rng = np.random.default_rng(4)
    vocabulary = [bytes(rng.integers(97, 110, size=n)).decode() for n in rng.integers(2, 12, size=60)] + ["été", "日本", "Zug."]
    rows = [(i, " ".join(rng.choice(vocabulary, size=int(rng.integers(0, 60))))) for i in range(40)] + [(50, None), (None, "zug zug"), (51, "q" * 5000)]
    texts = [(i, (t or "").encode()) for i, t in rows]
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    code = code_of(train, mm.PAIRS)
    seen, start = plain_counts(code, train), mm.start_weights()
    want = sorted((str(i), plain_bits(code, seen, t, start)) for i, t in texts)
    got = sorted((str(r.doc_id), -r.score / math.log10(2)) for r in score_language(docs(spark, rows).repartition(3), bucket_bytes=2000).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) <= 1e-3 * max(1, w[1]) for g, w in zip(got, want))


def test_contexts_grow_with_the_training_texts(spark):
    """Of many more contexts than any fixed number of slots, an unseen one
    still counts as unseen: random letters cost what the code alone asks."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(bytes(range(35, 65)) + bytes(range(91, 125)), np.uint8)
    rows = [(i, letters[rng.integers(0, 64, size=40000)].tobytes().decode()) for i in range(100)]
    got = score_language(docs(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 3
    assert sum(-r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held) < 6.05
