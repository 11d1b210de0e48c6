"""DuckDB text for the oracles, generated from the same fixed values as the
Spark expressions (fold table, token pattern, weights)."""

from __future__ import annotations

from docsift.functions.text import FOLD_FROM, FOLD_MULTI, FOLD_TO, WORD_SPLIT, WORD_TOKEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(expr: str) -> str:
    out = f"translate(lower({expr}), {q(FOLD_FROM)}, {q(FOLD_TO)})"
    for a, b in FOLD_MULTI:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def tokens(expr: str) -> str:
    """Folded word tokens of ``expr`` as a list."""
    return f"list_filter(regexp_split_to_array({fold(expr)}, {q(WORD_SPLIT)}), lambda t: t <> '')"


def words(expr: str) -> str:
    """Original-case word tokens."""
    return f"regexp_extract_all({expr}, {q(WORD_TOKEN)})"


def folded_words(expr: str) -> str:
    return f"regexp_extract_all({fold(expr)}, {q(WORD_TOKEN)})"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def ancestors(expr: str, sep: str = "/") -> str:
    """All prefixes of a hierarchy ('' -> [''], callers filter empty paths)."""
    parts = f"string_split({expr}, {q(sep)})"
    return (f"list_transform(range(1, len({parts}) + 1), "
            f"lambda i: array_to_string(list_slice({parts}, 1, i), {q(sep)}))")


def depth(expr: str) -> str:
    return (f"CAST(CASE WHEN length({expr}) = 0 THEN 0 "
            f"ELSE length({expr}) - length(replace({expr}, '/', '')) + 1 END AS BIGINT)")


def parent(expr: str) -> str:
    return f"CASE WHEN strpos({expr}, '/') = 0 THEN NULL ELSE regexp_replace({expr}, '/[^/]*$', '') END"
