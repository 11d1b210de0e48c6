"""Text analysis expressions (T1-T3, T15 helpers): tokenizers as built-in
array expressions, so tokenizing stays JVM-side and vectorised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accent folding of lower-case letters, each group to one ASCII letter.
FOLD_GROUPS = [
    ("àáâãäåā", "a"), ("çćč", "c"), ("èéêëēėę", "e"), ("ìíîïī", "i"), ("ñń", "n"),
    ("òóôõöøō", "o"), ("ùúûüū", "u"), ("ýÿ", "y"), ("žźż", "z"), ("šś", "s"), ("ł", "l"), ("đ", "d"),
]
# Folded letters that become two ASCII letters.
FOLD_MULTI = [("ß", "ss"), ("æ", "ae"), ("œ", "oe")]

FOLD_FROM = "".join(g for g, _ in FOLD_GROUPS)
FOLD_TO = "".join(a * len(g) for g, a in FOLD_GROUPS)

WORD_SPLIT = r"[^\p{L}\p{N}]+"
WORD_TOKEN = r"[\p{L}\p{N}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text) -> Column:
    """Lower-case and fold accents to ASCII."""
    out = F.translate(F.lower(_c(text)), FOLD_FROM, FOLD_TO)
    for a, b in FOLD_MULTI:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def standard_tokens(text) -> Column:
    """Word tokens of folded lower-case text, empty pieces dropped."""
    return F.filter(F.split(fold(text), WORD_SPLIT), lambda t: t != "")


def trigrams(text) -> Column:
    """Character 3-grams of folded lower-case text (none below 3 chars).
    Characters are cut once and joined with their neighbours, so the work is
    linear in the text."""
    chars = F.regexp_extract_all(fold(text), F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(chars), F.lit(0))
    two = F.zip_with(chars, F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(chars, F.lit(3), n), lambda a, b: F.concat(a, b))
    return F.filter(three, lambda g: g.isNotNull())
