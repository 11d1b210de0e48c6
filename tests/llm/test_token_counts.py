"""Token counts against the tokenizer itself."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import AWKWARD, EXTRA, docs

from conftest import SF_SMALL
from docsift.llm import queries
from docsift.llm.token_counts import MODEL, _model, count_texts, count_tokens, whole_tokens


def exact(text):
    return len(_model(MODEL).encode(text or ""))


def test_whole_tokens_are_single():
    marked, bare = whole_tokens()
    model = _model(MODEL)
    assert len(marked) > 10000 and len(bare) > 10000
    for w in random.Random(1).sample(sorted(marked), 300):
        assert len(model.encode(w)) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t▁ab the<s>é日\u0085 'x\r\x00")), max_size=40))
def test_any_text(text):
    assert count_texts([text]) == [exact(text)]


def test_query_is_exact(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_token_counts"](spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].n_tokens == exact(r.text)
        assert got[r.doc_id].n_bytes == len(r.text.encode())
        assert got[r.doc_id].over_limit == (exact(r.text) > 4096)


def test_awkward(spark):
    got = count_tokens(docs(spark, AWKWARD, EXTRA)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(
        (str(i), len((t or "").encode()), exact(t)) for i, t in AWKWARD)
    assert count_tokens(docs(spark, [])).collect() == []
