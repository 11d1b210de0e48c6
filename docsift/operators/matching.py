"""T7 and its kin: search expressions over the text index.

An expression is a tree of words, prefixes, phrases, words near each other and
field choices, joined by AND, OR and NOT.  ``matching`` turns it into semi and
anti joins over the postings of its words: every leaf reads only its own token
ranges, ids meet ids, and no text is read.  Phrases and NEAR are decided on the
positions of the postings.  ``query_scores`` ranks the matches, each word, prefix
or phrase that is not excluded counting as a term.  ``parse_query`` reads the
written form::

    red fox              both words (so does: red AND fox)
    red OR fox           either
    red NOT (fox OR dog) the first without the second
    "red fox"            next to each other, in order
    fo*                  a word that begins so
    title : red          in that field;  {name title} : (red OR fox)  in one of them
    NEAR(red "the fox", 5)   in one field, at most 5 words between the end of the
                         first and the start of the last (10 if left out)

Words side by side bind tightest, then NOT, AND, OR.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.fulltext import FIELD_WEIGHTS, TextIndex, _moved, _weight, fold_terms, phrase_matches, score_matches

NEAR_WORDS = 10  # fixed value: words between, if NEAR does not say


class QuerySyntaxError(ValueError):
    """The written form of a query is broken."""


@dataclass(frozen=True)
class Phrase:
    """Words next to each other, in order; a single word is a phrase of one."""
    words: tuple[str, ...]


@dataclass(frozen=True)
class Prefix:
    start: str


@dataclass(frozen=True)
class Near:
    parts: tuple[Phrase, ...]
    distance: int = NEAR_WORDS


@dataclass(frozen=True)
class In:
    node: Node
    fields: tuple[str, ...]


@dataclass(frozen=True)
class AllOf:
    nodes: tuple[Node, ...]


@dataclass(frozen=True)
class AnyOf:
    nodes: tuple[Node, ...]


@dataclass(frozen=True)
class Without:
    node: Node
    excluded: Node


Node = Phrase | Prefix | Near | In | AllOf | AnyOf | Without


def phrase_of(text: str) -> Phrase:
    """The words of a text, folded as in the index."""
    words = "".join(c if c.isalnum() else " " for c in fold_terms([text])[0]).split()
    if not words:
        raise QuerySyntaxError(f"no word in {text!r}")
    return Phrase(tuple(words))


# -------------------------------------------------------------- written form

_TOKEN = re.compile(r'\s*("(?:[^"]|"")*"|[(){}:,*]|[^\s(){}:,*"]+)')
_JOINS = ("AND", "OR", "NOT")


class _Reader:
    def __init__(self, text: str, fields: tuple[str, ...]):
        self.fields, self.tokens, at = fields, [], 0
        while at < len(text.rstrip()):
            found = _TOKEN.match(text, at)
            if not found:
                raise QuerySyntaxError(f"open quote at {at}: {text!r}")
            self.tokens.append(found[1])
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or (wanted is not None and token != wanted):
            raise QuerySyntaxError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def joined(self, level: int) -> Node:
        """Levels from loosest: OR, AND, NOT; below them words side by side."""
        if level == 3:
            nodes = [self.unit()]
            while self.peek() not in (None, ")", ",", "}", *_JOINS):
                nodes.append(self.unit())
            return nodes[0] if len(nodes) == 1 else AllOf(tuple(nodes))
        word, nodes = ("OR", "AND", "NOT")[level], [self.joined(level + 1)]
        while self.peek() == word:
            self.take()
            nodes.append(self.joined(level + 1))
        if level == 2:
            return functools.reduce(Without, nodes)
        return nodes[0] if len(nodes) == 1 else (AnyOf, AllOf)[level](tuple(nodes))

    def unit(self) -> Node:
        token = self.take()
        if token == "(":
            node = self.joined(0)
            self.take(")")
            return node
        if token == "{" or (self.peek() == ":" and not token.startswith('"')):
            names = [token]
            if token == "{":
                names = []
                while self.peek() != "}":
                    names.append(self.take())
                self.take("}")
            self.take(":")
            if not names or any(n not in self.fields for n in names):
                raise QuerySyntaxError(f"unknown field in {names}")
            return In(self.unit(), tuple(names))
        if token == "NEAR" and self.peek() == "(":
            self.take("(")
            parts = []
            while self.peek() not in (")", ","):
                parts.append(self.phrase(self.take()))
            distance = NEAR_WORDS
            if self.peek() == ",":
                self.take()
                number = self.take()
                if not number.isdecimal():
                    raise QuerySyntaxError(f"NEAR needs a number, found {number}")
                distance = int(number)
            self.take(")")
            if not parts:
                raise QuerySyntaxError("NEAR of nothing")
            return Near(tuple(parts), distance)
        phrase = self.phrase(token)
        if self.peek() == "*":
            self.take()
            if len(phrase.words) > 1:
                raise QuerySyntaxError("a prefix is one word")
            return Prefix(phrase.words[0])
        return phrase

    @staticmethod
    def phrase(token: str) -> Phrase:
        if token in _JOINS or token in tuple("(){}:,*"):
            raise QuerySyntaxError(f"misplaced {token}")
        return phrase_of(token[1:-1].replace('""', '"') if token.startswith('"') else token)


def parse_query(text: str, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS)) -> Node:
    """The tree of a written query; ``QuerySyntaxError`` if it is broken."""
    reader = _Reader(text, tuple(fields))
    node = reader.joined(0)
    if reader.peek() is not None:
        raise QuerySyntaxError(f"misplaced {reader.peek()}")
    return node


# ------------------------------------------------------------------ matching

def _narrowed(fields: list[str] | None, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if fields is None or n in fields]


def _in_fields(postings: DataFrame, fields: list[str] | None) -> DataFrame:
    return postings if fields is None else postings.where(F.col("field").isin(list(fields)) if fields else F.lit(False))


def _leaf(postings: DataFrame, leaf: Phrase | Prefix, fields: list[str] | None) -> DataFrame:
    """(id, field, dl, tf) of a word, a phrase or a prefix."""
    if isinstance(leaf, Phrase) and len(leaf.words) > 1:
        return phrase_matches(postings, list(leaf.words), fields)
    token = F.col("token")
    rows = postings.where(token.startswith(leaf.start) if isinstance(leaf, Prefix) else token == leaf.words[0])
    return _in_fields(rows, fields).select("id", "field", "dl", "tf")


def _near_ids(postings: DataFrame, node: Near, fields: list[str] | None) -> DataFrame:
    words = sorted({w for p in node.parts for w in p.words})
    rows = _in_fields(postings.where(F.col("token").isin(words)), fields)
    per = (rows.groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("token", "pos"))).alias("m"))
           .where(F.size("m") == len(words)))
    starts = [functools.reduce(F.array_intersect, [_moved(F.col("m")[w], i) for i, w in enumerate(p.words)]) for p in node.parts]
    lengths, distance = [len(p.words) for p in node.parts], node.distance

    @F.pandas_udf("boolean")
    def near(places: pd.Series) -> pd.Series:
        """Whether some part begins, and all others soon after it: sorted
        places are merged, in time linear in their number."""
        out = []
        for row in places:
            found = False
            for j, first in enumerate(row):
                ok = np.ones(len(first), dtype=bool)
                for i, other in enumerate(row):
                    if i != j:
                        at = np.searchsorted(other, first)
                        ok &= (at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= first + lengths[j] + distance) if len(other) else False
                found = found or bool(ok.any())
            out.append(found)
        return pd.Series(out, dtype=bool)

    return per.where(near(F.array(*starts))).select("id").distinct()


def matching(postings: DataFrame, node: Node, fields: list[str] | None = None) -> DataFrame:
    """Distinct ids of the documents that match (in ``fields``, or any)."""
    if isinstance(node, In):
        return matching(postings, node.node, _narrowed(fields, node.fields))
    if isinstance(node, Near):
        return _near_ids(postings, node, fields) if len(node.parts) > 1 else matching(postings, node.parts[0], fields)
    if isinstance(node, Without):
        return matching(postings, node.node, fields).join(matching(postings, node.excluded, fields), "id", "left_anti")
    if isinstance(node, (AllOf, AnyOf)):
        # words are looked up together; the rest one by one
        words = sorted({n.words[0] for n in node.nodes if isinstance(n, Phrase) and len(n.words) == 1})
        rest = [matching(postings, n, fields) for n in node.nodes if not (isinstance(n, Phrase) and len(n.words) == 1)]
        if words:
            rows = _in_fields(postings.where(F.col("token").isin(words)), fields)
            rows = rows.groupBy("id").agg(F.count_distinct("token").alias("n"))
            rest.insert(0, (rows.where(F.col("n") == len(words)) if isinstance(node, AllOf) else rows).select("id"))
        if isinstance(node, AllOf):
            return functools.reduce(lambda a, b: a.join(b, "id", "left_semi"), rest)
        return functools.reduce(lambda a, b: a.unionByName(b), rest).distinct()
    return _leaf(postings, node, fields).select("id").distinct()


def _ranked(node: Node, fields: list[str] | None) -> list[tuple[Phrase | Prefix, tuple[str, ...] | None]]:
    """Leaves that count for the rank, with the fields they are looked up in."""
    if isinstance(node, In):
        return _ranked(node.node, _narrowed(fields, node.fields))
    if isinstance(node, Without):
        return _ranked(node.node, fields)
    if isinstance(node, (AllOf, AnyOf)):
        return [x for n in node.nodes for x in _ranked(n, fields)]
    if isinstance(node, Near):
        return [x for p in node.parts for x in _ranked(p, fields)]
    return [(node, None if fields is None else tuple(fields))]


def query_scores(index: TextIndex, node: Node | str, fields: list[str] | None = None) -> DataFrame:
    """(id, score) of the matches of an expression: BM25 where every different
    word, prefix or phrase that is not excluded is a term."""
    node = parse_query(node) if isinstance(node, str) else node
    leaves = list(dict.fromkeys(_ranked(node, fields)))
    parts = [_leaf(index.postings, leaf, None if at is None else list(at)).groupBy("id", "dl").agg(F.sum(F.col("tf") * _weight(FIELD_WEIGHTS)).alias("f"))
             .withColumn("token", F.lit(i)) for i, (leaf, at) in enumerate(leaves)]
    f = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return score_matches(f, index.stats).join(matching(index.postings, node, fields), "id", "left_semi")
