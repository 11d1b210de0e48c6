"""Markup to text against a character-by-character parser, on whole and broken markup."""

import random
import re
from html.entities import name2codepoint

from pyspark.sql import functions as F

from docsift.sources import convert as C

WHITE = " \t\n\r\f"


def end_of_tag(s, i):
    """Place behind the tag whose attributes begin at ``i``."""
    while i < len(s):
        if s[i] == ">":
            return i + 1
        if s[i] == "=":
            i += 1
            while i < len(s) and s[i] in WHITE:
                i += 1
            if i < len(s) and s[i] in "\"'":
                close = s.find(s[i], i + 1)
                i = len(s) if close < 0 else close + 1
        else:
            i += 1
    return i


def named(s, i, word):
    """Whether a tag of this name begins at ``i``."""
    n = i + len(word)
    return s[i:n].lower() == word and (n == len(s) or s[n] in WHITE + "/>")


def reference(m):
    body = m[0][1:].rstrip(";")
    if body[0] != "#":
        return " " if body == "nbsp" else "'" if body == "apos" else chr(name2codepoint[body]) if body in name2codepoint else m[0]
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return " " if code == 160 else chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else "�"


def plain(s):
    out, i = [], 0
    while i < len(s):
        if s.startswith("<!--", i):
            end = s.find("-->", i + 4)
            out.append(" ")
            i = len(s) if end < 0 else end + 3
        elif s[i:i + 9].upper() == "<![CDATA[":
            end = s.find("]]>", i + 9)
            out.append(s[i + 9:] if end < 0 else s[i + 9:end])
            i = len(s) if end < 0 else end + 3
        elif any(named(s, i + 1, w) and s[i] == "<" for w in ("script", "style")):
            word = "script" if named(s, i + 1, "script") else "style"
            i = end_of_tag(s, i + 1 + len(word))
            while i < len(s) and not (s.startswith("</", i) and named(s, i + 2, word)):
                i += 1
            i = end_of_tag(s, i + 2 + len(word)) if i < len(s) else i
            out.append(" ")
        elif s[i] == "<" and i + 1 < len(s) and re.match("[a-zA-Z/!?]", s[i + 1]):
            i = end_of_tag(s, i + 2)
            out.append(" ")
        else:
            stop = s.find("<", i + 1)
            stop = len(s) if stop < 0 else stop
            out.append(re.sub(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)", reference, s[i:stop]))
            i = stop
    return re.sub(r"[ \t\n\r\f]+", " ", "".join(out)).strip(" ")


PARTS = ["<p>", "</p>", "<a href=\"x>y\">", "<a b='1", "\"", "'", "<!-- c -->", "<!--", "-->", "<![CDATA[", "]]>", "<script>", "</script >", "<STYLE a=1>",
         "</style>", "<scripty>", "<", ">", "=", " = ", "a", "é", "日", "  ", "\n", "&amp;", "&lt;b&gt;", "&#65;", "&#x1F600;", "&#0;", "&#xD800;", "&#99999999999999999999;",
         "&#65", "&nbsp;", "&#160;", "&bogus;", "&amp", "&", "<?xml", "<!doctype html>", "</", "<br/>", "x < y", "&eacute;", "&#x;", "&#;", "<3"]


def texts(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, html string")
    return [r.text for r in df.select("id", C.markup_to_text("html").alias("text")).orderBy("id").collect()]


def test_random_broken_markup(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for html, got in zip(rows, texts(spark, rows)):
        assert got == plain(html), html


def test_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert [g for g in texts(spark, pages)] == [None if p is None else plain(p) for p in pages]


def test_long_and_null(spark):
    """Linear: much of everything, nothing closed."""
    rows = [None, "", "<" * 200_000, "<a " + "b=1 " * 100_000, "&amp;" * 50_000, "<!--" * 50_000, "<a href='" * 20_000, "x" * 1_000_000, "<p>" * 100_000]
    got = texts(spark, rows)
    assert got[0] is None and got[1] == "" and got[2] == "<" * 200_000 and got[3] == "" and got[4] == "&" * 50_000
    assert got[5:] == ["", "", "x" * 1_000_000, ""]
