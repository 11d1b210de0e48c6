"""Search expressions: what is read, what is refused, and random trees against plain Python."""

import random

import pytest

from docsift.operators import matching as M
from docsift.operators import segments as SG
from docsift.operators.search import SearchRequest, search

A, B, C = (M.Phrase((w,)) for w in ("a", "b", "c"))


def test_written_form():
    assert M.parse_query("a b OR c") == M.AnyOf((M.AllOf((A, B)), C))
    assert M.parse_query("a AND b OR c") == M.AnyOf((M.AllOf((A, B)), C))
    assert M.parse_query("a AND b NOT c") == M.AllOf((A, M.Without(B, C)))
    assert M.parse_query("a b NOT c") == M.Without(M.AllOf((A, B)), C)
    assert M.parse_query("a NOT b NOT c") == M.Without(M.Without(A, B), C)
    assert M.parse_query("(a OR b) AND c") == M.AllOf((M.AnyOf((A, B)), C))
    assert M.parse_query('"A  b"') == M.Phrase(("a", "b")) and M.parse_query("a-b") == M.Phrase(("a", "b"))
    assert M.parse_query("Été*") == M.Prefix("ete") and M.parse_query('"a"*') == M.Prefix("a")
    assert M.parse_query("title : a b") == M.AllOf((M.In(A, ("title",)), B))
    assert M.parse_query("{name title} : (a OR b)") == M.In(M.AnyOf((A, B)), ("name", "title"))
    assert M.parse_query('NEAR(a "b c")') == M.Near((A, M.Phrase(("b", "c"))), 10)
    assert M.parse_query("NEAR(a b, 3) c") == M.AllOf((M.Near((A, B), 3), C))
    assert M.parse_query('"say ""a"""') == M.Phrase(("say", "a"))


@pytest.mark.parametrize("text", ["", "  ", "a AND", "OR a", "(a", "a)", "NOT a", '"open', "...", "a OR OR b", "colour : a", "{} : a", "NEAR()",
                                  "NEAR(a b, x)", "NEAR(a b", "* a", '"a b"*', "a : : b", "a NOT"])
def test_broken_queries_raise(text):
    with pytest.raises(M.QuerySyntaxError):
        M.parse_query(text)


FIELDS = ["name", "content", "title", "path"]


def holds(node, doc, fields):
    """Plain evaluation on the word lists of a document."""
    if isinstance(node, M.In):
        return holds(node.node, doc, [f for f in node.fields if f in fields])
    if isinstance(node, M.AllOf):
        return all(holds(n, doc, fields) for n in node.nodes)
    if isinstance(node, M.AnyOf):
        return any(holds(n, doc, fields) for n in node.nodes)
    if isinstance(node, M.Without):
        return holds(node.node, doc, fields) and not holds(node.excluded, doc, fields)
    if isinstance(node, M.Prefix):
        return any(w.startswith(node.start) for f in fields for w in doc[f])
    if isinstance(node, M.Phrase):
        return any(starts(node.words, doc[f]) for f in fields)
    for f in fields:
        places = [starts(p.words, doc[f]) for p in node.parts]
        for j, part in enumerate(node.parts):
            for p in places[j]:
                if all(any(p <= q <= p + len(part.words) + node.distance for q in places[i]) for i in range(len(places)) if i != j):
                    return True
    return False


def starts(words, tokens):
    return [i for i in range(len(tokens)) if tuple(tokens[i:i + len(words)]) == tuple(words)]


def tree(rng, depth):
    words = lambda n: tuple(rng.choice("abcde") for _ in range(n))
    kind = rng.randrange(8) if depth else rng.randrange(4)
    if kind <= 1:
        return M.Phrase(words(rng.choice([1, 1, 2, 3])))
    if kind == 2:
        return M.Prefix(rng.choice(["a", "b", "zz", "q"]))
    if kind == 3:
        return M.Near(tuple(M.Phrase(words(rng.choice([1, 1, 2]))) for _ in range(rng.choice([2, 2, 3]))), rng.randrange(4))
    if kind == 4:
        return M.In(tree(rng, depth - 1), tuple(rng.sample(FIELDS, rng.randint(1, 3))))
    if kind == 5:
        return M.Without(tree(rng, depth - 1), tree(rng, depth - 1))
    return (M.AllOf if kind == 6 else M.AnyOf)(tuple(tree(rng, depth - 1) for _ in range(rng.randint(2, 3))))


def test_random_trees(spark, tmp_path):
    rng = random.Random(3)
    docs = {i: {f: [rng.choice("abcdefgz") * rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(8))] for f in FIELDS} for i in range(120)}
    rows = [(i, *(" ".join(d[f]) for f in FIELDS)) for i, d in docs.items()]
    ix = SG.create_index(spark.createDataFrame(rows, "id long, name string, content string, title string, path string"), str(tmp_path / "ix"))
    postings, sizes = ix.postings.cache(), set()
    for n in range(25):
        node = tree(rng, 2)
        fields = None if n % 3 else rng.sample(FIELDS, 2)
        got = [r.id for r in M.matching(postings, node, fields).collect()]
        assert sorted(got) == [i for i, d in docs.items() if holds(node, d, fields or FIELDS)], node
        if n < 8:
            assert sorted(r.id for r in M.query_scores(ix, node, fields).collect()) == sorted(got)
        sizes.add(len(got))
    assert len(sizes) > 8


def test_a_request_with_an_expression(spark, tmp_path):
    rows = [(1, 1, "", "", "red fox", "", 10, 1), (2, 1, "", "red", "dog", "", 20, 1), (3, 1, "", "", "the red dog and fox", "", 30, 1)]
    docs = spark.createDataFrame(rows, "id long, index_id int, path string, name string, content string, title string, size long, mtime long")
    ix = SG.create_index(docs, str(tmp_path / "ix"))
    req = SearchRequest(query='(red OR dog) NOT "red fox"', sort="size", highlight=True)
    page, _ = search(docs, req, index=ix, columns=["id", "name"])
    assert {r.id: r.snippet for r in page.collect()} == {2: "<mark>dog</mark>", 3: "<mark>red</mark> <mark>dog</mark> and fox"}
    with pytest.raises(M.QuerySyntaxError):
        search(docs, SearchRequest(query="(red"), index=ix)


def plain_window(tokens, parts, n):
    hits = sorted((p, p + len(w), k) for k, w in enumerate(parts) for p in starts(w, tokens))
    best, top = 0, -1
    for s, _, _ in hits:
        inside = [k for b, e, k in hits if b >= s and e <= s + n]
        score = 1000 * len(set(inside)) + len(inside) - len(set(inside))
        if score > top:
            best, top = s, score
    return best, sorted({i for b, e, _ in hits if b >= best and e <= best + n for i in range(b, e)})


def test_windows_prefer_different_terms():
    from docsift.operators.fulltext import best_window

    rng = random.Random(4)
    for _ in range(400):
        tokens = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        parts = [[rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(rng.randint(1, 3))]
        words = {w for p in parts for w in p}
        places = [(i, t) for i, t in enumerate(tokens) if t in words]
        n = rng.randint(1, 9)
        assert best_window(places, parts, n) == plain_window(tokens, parts, n)
    long = [(i, "ab"[i % 2]) for i in range(200_000)]
    assert best_window(long, [["a"], ["b"], ["a", "b"]], 20)[0] == 0  # one pass


def test_snippet_of_two_different_terms_beats_three_repeats(spark):
    from docsift.operators.fulltext import highlight

    text = "red red red " + "x " * 30 + "red Füchse y"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no hit here")], "id long, content string")
    got = {r.id: r.snippet for r in highlight(docs, ["red", "fuchse"], n=4).collect()}
    assert got == {1: "<mark>red</mark> <mark>Füchse</mark> y", 2: "", 3: "", 4: "no hit here"}
    phrase = {r.id: r.snippet for r in highlight(docs, ["red füchse"], n=3).collect()}
    assert phrase[1] == "<mark>red</mark> <mark>Füchse</mark> y"
