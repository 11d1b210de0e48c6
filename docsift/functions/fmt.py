"""Display formatting as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Size unit letters for 1000^1 .. 1000^8.
SIZE_UNITS = ["k", "M", "G", "T", "P", "E", "Z", "Y"]


def human_size(b) -> Column:
    """Base-1000 size: '0 B', 'n B' below 1000, otherwise one decimal and a
    unit letter.  The decimal is rounded half-up in exact integer arithmetic,
    so the text does not depend on floating-point division."""
    b = _c(b).cast("long")
    digits = F.length(F.abs(b).cast("string"))
    u = F.least(F.floor((digits - 1) / 3).cast("int") - 1, F.lit(len(SIZE_UNITS) - 1))
    unit = F.pow(F.lit(1000), u + 1).cast("decimal(38,0)")
    tenths = F.floor((F.abs(b).cast("decimal(38,0)") * 10 + F.floor(unit / 2)) / unit).cast("long")
    letter = F.element_at(F.array(*[F.lit(x) for x in SIZE_UNITS]), u + 1)
    text = F.format_string("%d.%d%s", F.floor(tenths / 10).cast("long"), (tenths % 10).cast("long"), letter)
    return (
        F.when(b == 0, F.lit("0 B"))
        .when(F.abs(b) < 1000, F.concat(b.cast("string"), F.lit(" B")))
        .when(b < 0, F.concat(F.lit("-"), text))
        .otherwise(text)
    )


def human_time(sec) -> Column:
    """'Ns' below a minute, 'mm:ss' below an hour, else 'hh:mm:ss'."""
    s = F.floor(_c(sec)).cast("long")
    h = F.floor(s / 3600).cast("long")
    m = F.floor((s - h * 3600) / 60).cast("long")
    r = s - h * 3600 - m * 60

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(two(m), F.lit(":"), two(r)))
        .otherwise(F.concat(F.when(h < 10, F.lpad(h.cast("string"), 2, "0")).otherwise(h.cast("string")),
                            F.lit(":"), two(m), F.lit(":"), two(r)))
    )


def human_date(epoch) -> Column:
    """UTC 'yyyy-MM-dd' of an epoch second, computed as whole days after
    1970-01-01 so the result does not depend on the session time zone."""
    days = F.floor(_c(epoch) / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def dms_to_decimal(dms, ref) -> Column:
    """'d:1, m:1, s:100' rationals with an N/S/E/W reference -> signed degrees."""
    parts = F.split(_c(dms), ",")

    def rational(i):
        tok = F.trim(F.element_at(parts, i))
        return F.split(tok, ":").getItem(0).cast("double") / F.split(tok, ":").getItem(1).cast("double")

    value = rational(1) + rational(2) / 60 + rational(3) / 3600
    sign = F.when(_c(ref).isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return value * sign


def file_url(base: str, path, name, extension) -> Column:
    """base + path/name.ext with '#' escaped as %23."""
    path, name, extension = _c(path), _c(name), _c(extension)
    file = F.when(F.length(extension) > 0, F.concat(name, F.lit("."), extension)).otherwise(name)
    rel = F.when(F.length(path) == 0, file).otherwise(F.concat(path, F.lit("/"), file))
    return F.concat(F.lit(base), F.replace(rel, F.lit("#"), F.lit("%23")))


_SLOT = re.compile(r"\$\{([^}]*)}")
_FIELD = re.compile(r"^\s*doc\.([A-Za-z_][A-Za-z0-9_]*)\s*$")
_CALL = re.compile(r"^\s*(humanFileSize|humanDate)\(\s*doc\.([A-Za-z_][A-Za-z0-9_]*)\s*\)\s*$")


def featured_line(template: str) -> Column:
    """Compile a '${...}' template into a concat of columns.

    A slot is ``doc.<field>``, ``humanFileSize(doc.<field>)`` or
    ``humanDate(doc.<field>)``; nothing is evaluated as code.
    """
    pieces: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        expr = m.group(1)
        f = _FIELD.match(expr)
        c = _CALL.match(expr)
        if f:
            pieces.append(F.coalesce(F.col(f.group(1)).cast("string"), F.lit("undefined")))
        elif c:
            fn = human_size if c.group(1) == "humanFileSize" else human_date
            pieces.append(fn(F.col(c.group(2))))
        else:
            raise ValueError(f"unsupported template slot: {expr!r}")
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces) if pieces else F.lit("")
