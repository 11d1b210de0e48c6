"""Packed document ids (P4): sid = (index_id << 32) | doc_id, text '%08x.%08x'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_sid(index_id, doc_id) -> Column:
    return F.shiftleft(_c(index_id).cast("long"), 32).bitwiseOR(_c(doc_id).cast("long"))


def unpack_index(sid) -> Column:
    return F.shiftright(_c(sid), 32)


def unpack_doc(sid) -> Column:
    return _c(sid).bitwiseAND(F.lit(0xFFFFFFFF))


def format_sid(sid) -> Column:
    return F.format_string("%08x.%08x", unpack_index(sid), unpack_doc(sid))


def parse_sid(text) -> Column:
    """'%08x.%08x' text back to the packed 64-bit id."""
    t = _c(text)
    hi = F.conv(F.substring_index(t, ".", 1), 16, 10).cast("long")
    lo = F.conv(F.substring_index(t, ".", -1), 16, 10).cast("long")
    return pack_sid(hi, lo)
