"""Text extraction from markup and JSON (S8, S9) with built-in expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]+"

# What follows the name of a tag up to its end: a quote opens a value only behind
# an equals sign, and then the value may hold ">"; an open quote or tag runs to
# the end of the text.  Every loop is possessive, so the scan is linear.
ATTRIBUTES = r"""(?:[^=>]++|=[ \t\n\r\f]*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
COMMENT = r"<!--.*?(?:-->|\z)"
CDATA = r"<!\[CDATA\[.*?(?:\]\]>|\z)"
BLOCK = rf"<(script|style)(?=[ \t\n\r\f/>]|\z){ATTRIBUTES}.*?(?:</\1(?=[ \t\n\r\f/>]|\z){ATTRIBUTES}|\z)"
TAG = rf"<[a-z/!?]{ATTRIBUTES}"
PIECE = rf"(?is){COMMENT}|{CDATA}|{BLOCK}|{TAG}|[^<]++|<"

# A numeric reference (its semicolon may be missing) or a named one.
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;)"
NAMED = {name: " " if name == "nbsp" else chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def _referred(ref: Column) -> Column:
    """The character of a reference: unknown names stay as they are, impossible
    numbers are U+FFFD, U+00A0 is a blank."""
    body = F.rtrim(F.substr(ref, F.lit(2)), F.lit(";"))
    digits = F.when(body.startswith("#x") | body.startswith("#X"), F.ltrim(F.substr(body, F.lit(3)), F.lit("0"))).otherwise(
        F.ltrim(F.substr(body, F.lit(2)), F.lit("0")))
    number = F.when(body.startswith("#x") | body.startswith("#X"), F.conv(F.substr(digits, F.lit(1), F.lit(8)), 16, 10)).otherwise(
        F.substr(digits, F.lit(1), F.lit(10)))
    code = F.when(F.length(digits) > 8, F.lit(-1)).otherwise(F.coalesce(number.try_cast("long"), F.lit(-1)))
    possible = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(code == 160, F.lit(" ")).when(possible, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), body)
    return F.when(body.startswith("#"), char).otherwise(F.coalesce(named, ref))


def _without_references(text: Column) -> Column:
    parts, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    rest = F.zip_with(refs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda r, t: F.concat(_referred(r), F.coalesce(t, F.lit(""))))
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.element_at(parts, 1), F.array_join(rest, "")))


def markup_to_text(html) -> Column:
    """The text of marked-up pages, whole or broken.

    The markup is cut into pieces in one scan: comments, CDATA sections, script
    and style blocks, tags (a quoted value may hold ``>``), and text.  What is
    not closed runs to the end.  Comments, blocks and tags become blanks, CDATA
    sections their content as it stands; in text, numeric and named references
    are decoded once.  White space is collapsed and trimmed."""
    c = F.col(html) if isinstance(html, str) else html

    def text_of(piece: Column) -> Column:
        low = F.upper(F.substr(piece, F.lit(1), F.lit(9)))
        content = F.regexp_replace(F.substr(piece, F.lit(10)), r"\]\]>\z", "")
        return (F.when(low == "<![CDATA[", content).when(piece.rlike(r"(?i)\A<[a-z/!?]"), F.lit(" "))
                .otherwise(_without_references(piece)))

    text = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), text_of), "")
    return F.trim(F.regexp_replace(text, SPACE, " "))


# A string (with the colon behind it, if it is a key), a number or a truth value.
SCALAR = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false'


def _json_lines(js) -> Column:
    c = F.col(js) if isinstance(js, str) else js
    return F.filter(F.split(c, "\n"), lambda line: F.trim(line) != "")


def json_to_text(js) -> Column:
    """The scalar values of a JSON text - or of every line of an NDJSON
    text - in document order, joined by spaces, those of nested objects and
    arrays included; keys and nulls are left out.  A line that does not parse
    gives nothing (see ``json_bad_lines``)."""
    def values(line: Column) -> Column:
        found = F.filter(F.regexp_extract_all(line, F.lit(SCALAR), F.lit(0)), lambda t: ~t.endswith(":"))
        return F.transform(found, lambda t: F.when(
            t.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)).otherwise(t))

    good = F.filter(_json_lines(js), lambda line: F.try_parse_json(line).isNotNull())
    return F.array_join(F.flatten(F.transform(good, values)), " ")


def json_bad_lines(js) -> Column:
    """How many lines do not parse."""
    return F.size(F.filter(_json_lines(js), lambda line: F.try_parse_json(line).isNull())).cast("long")
