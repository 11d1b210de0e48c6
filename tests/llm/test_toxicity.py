"""Toxicity: feature counts against brute force, held-out accuracy, no leaks."""

import random
import zlib

import numpy as np
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm import toxicity as tx


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=600, seed=2):
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    bad = ["idiot", "scumbag", "moronic", "worthless"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [rnd.choice(common) for _ in range(rnd.randint(5, 200))], rnd.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_block_scores_equal_distinct_ngrams():
    rnd = np.random.default_rng(1)
    weights = np.where(rnd.random(1 << tx.BITS) < 0.3, rnd.normal(size=1 << tx.BITS), 0).astype(np.float32)
    texts = ["", "a", "abc", "The Cat\tsat on the cat", "é日本" * 40, "aaaa" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = tx.score_block(data, offsets, weights)
    for t, g in zip(texts, got):
        low = t.encode().translate(tx.LOWER_SPACE_BYTES)
        grams = {int(tx.hashed_ngrams(np.frombuffer(low[i:i + n], np.uint8), n)[0])
                 for n in tx.ORDERS for i in range(len(low) - n + 1)}
        assert abs(g - sum(float(weights[b]) for b in grams)) < 1e-4


def test_held_out_accuracy_and_no_label_leak(spark):
    rows, labels = corpus()
    df, lab = docs(spark, rows, EXTRA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(df, tx.train_toxicity(df, lab)).collect()}
    assert all(got[i].held_out == held_out(i) for i, _ in labels)
    assert np.mean([got[i].predicted == y for i, y in labels if held_out(i)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    flipped = spark.createDataFrame([(i, 1 - y if held_out(i) else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in tx.score_toxicity(df, tx.train_toxicity(df.repartition(5), flipped)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_sample_bound(spark):
    lab = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    n = tx.training_sample(lab, 1000).count()
    assert 850 < n < 1150 and tx.training_sample(lab, 10**6).count() == sum(not held_out(i) for i in range(5000))


def test_awkward(spark):
    rows, labels = corpus(200)
    model = tx.train_toxicity(docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = tx.score_toxicity(docs(spark, AWKWARD, EXTRA), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert tx.score_toxicity(docs(spark, []), model).collect() == []
    none = tx.train_toxicity(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.score_toxicity(docs(spark, AWKWARD), none).collect()} == {0.5}


def test_filter_keeps_rows_whole(spark):
    rows, labels = corpus()
    df = docs(spark, [*rows, (9000, None)], EXTRA)
    model = tx.train_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = tx.filter_toxic(df, model)
    assert kept.schema == df.schema
    low = {r.doc_id for r in tx.score_toxicity(df, model).collect() if r.score < 0.5}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.doc_id in low)


def plain_buckets(text):
    """Buckets of all n-grams of a text, one by one."""
    low = (text or "").encode().translate(tx.LOWER_SPACE_BYTES)
    grams = {low[i:i + n] for n in tx.ORDERS for i in range(len(low) - n + 1)}
    return {int(tx.hashed_ngrams(np.frombuffer(g, np.uint8), len(g))[0]) for g in grams}


def plain_model(rows, labels, max_features=1 << 14, min_docs=3, penalty=1e-3, steps=100):
    """The classifier written out: counts, chi-square, naive Bayes log-count
    ratios, and a logistic regression on a dense matrix."""
    of = {}
    for i, y in labels:
        if i is not None and y is not None and not held_out(i):
            of[i] = max(of.get(i, 0), int(y > 0))
    found = [(plain_buckets(t), of[i]) for i, t in rows if i in of]
    toxic, other = sum(y for _, y in found), sum(1 - y for _, y in found)
    p, q = {}, {}
    for buckets, y in found:
        for b in buckets:
            (p if y else q)[b] = (p if y else q).get(b, 0) + 1
    strong = []
    for b in {*p, *q}:
        x, n = p.get(b, 0), toxic + other
        both = x + q.get(b, 0)
        if both >= min_docs:
            expected = both * toxic / n
            chi = (x - expected) ** 2 / max(expected * (1 - both / n) * (1 - toxic / n), 1e-9)
            if chi >= 10.8:
                strong.append((-chi, b))
    chosen = sorted(b for _, b in sorted(strong)[:max_features])
    ratio = np.array([np.log((p.get(b, 0) + 1) / (toxic + 2)) - np.log((q.get(b, 0) + 1) / (other + 2)) for b in chosen])
    x = np.array([[b in buckets for b in chosen] for buckets, _ in found], dtype=float).reshape(len(found), len(chosen)) * ratio
    y = np.array([y for _, y in found], dtype=float)
    w, bias = np.zeros(len(chosen)), np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    sum_w, sum_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -40, 40))) - y
        grad_w, grad_b = x.T @ error / len(y) + penalty * w, error.mean()
        sum_w, sum_b = sum_w + grad_w ** 2, sum_b + grad_b ** 2
        w, bias = w - 0.1 * grad_w / np.sqrt(sum_w), bias - 0.1 * grad_b / np.sqrt(sum_b)
    return dict(zip(chosen, w * ratio)), bias


def plain_score(model, text):
    weight, bias = model
    return 1 / (1 + np.exp(-np.clip(bias + sum(weight.get(b, 0.0) for b in plain_buckets(text)), -40, 40)))


def test_fit_equals_a_plain_fit(spark):
    rows, labels = corpus(240, seed=5)
    labels += [(labels[0][0], 1 - labels[0][1]), (None, 1), (7, None), (99999, 1)]  # two labels, none, no text
    model = tx.train_toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weights, bias = plain_model(rows, labels)
    assert model.buckets.tolist() == sorted(weights) and len(weights) > 50
    assert np.allclose(model.weights, [weights[b] for b in sorted(weights)], atol=1e-4) and abs(model.bias - bias) < 1e-4
    few = tx.train_toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), max_features=20)
    assert few.buckets.tolist() == sorted(plain_model(rows, labels, max_features=20)[0])


def test_query_equals_a_plain_fit(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()]
    model = plain_model(rows, labels)
    got = queries.QUERIES["op6_toxicity"](spark, SF_SMALL).collect()
    want = dict(rows)
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(want)
    for r in got:
        assert abs(r.score - plain_score(model, want[r.doc_id])) < 1e-3 and r.held_out == held_out(r.doc_id)
        assert r.predicted == int(r.score >= 0.5)
