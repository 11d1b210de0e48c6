"""Tag expressions (P14, P15): dotted tags whose last segment may be a colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.paths import hierarchy_tokens, strict_ancestors

COLOUR_PATTERN = r"\.#[0-9a-fA-F]{6}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_coloured(tag) -> Column:
    return _c(tag).rlike(COLOUR_PATTERN)


def tag_id(tag) -> Column:
    """'a.b.#rrggbb' -> 'a.b'; a tag without colour is its own id."""
    t = _c(tag)
    last = F.substring_index(t, ".", -1)
    return F.when(is_coloured(t), F.substring(t, F.lit(1), F.length(t) - F.length(last) - 1)).otherwise(t)


def tag_colour(tag) -> Column:
    t = _c(tag)
    return F.when(is_coloured(t), F.substring_index(t, ".", -1))


def parse_tag(tag) -> dict[str, Column]:
    """Id, colour (NULL when none) and leaf flag."""
    return {"tag_id": tag_id(tag), "colour": tag_colour(tag), "is_leaf": is_coloured(tag)}


def luminance(colour) -> Column:
    """0.2126 R + 0.7152 G + 0.0722 B of '#rrggbb'."""
    c = _c(colour)

    def chan(i):
        return F.conv(F.substring(c, i, 2), 16, 10).cast("int")

    return F.lit(0.2126) * chan(2) + F.lit(0.7152) * chan(4) + F.lit(0.0722) * chan(6)


def foreground(colour) -> Column:
    """Black text on light colours (luminance > 50), white otherwise."""
    return F.when(luminance(colour) > 50, F.lit("#000")).otherwise(F.lit("#fff"))


def tag_prefixes(tag) -> Column:
    """Hierarchy tokens on '.', self included (for facets and tag filters)."""
    return hierarchy_tokens(tag, ".")


def tag_strict_prefixes(tag) -> Column:
    return strict_ancestors(tag, ".")
