"""Scripts that change records.

A record is a document as one VARIANT object: its columns and its tags under
``tag``.  A script is a function from records (``id``, ``record``) to records,
written with DataFrame operations and the column functions below; it runs on the
executors like any other plan.  Documents that it does not return stay as they
are.  Afterwards the tag rows are rebuilt from the ``tag`` arrays, and only the
documents whose record has changed are handed on, so that an index takes them up
as one upsert.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Script = Callable[[DataFrame], DataFrame]
RECORD_SCRIPTS: dict[str, Script] = {}

_MAP = "map<string,variant>"


def record_script(name: str):
    """Register a script."""
    def add(fn: Script) -> Script:
        if name in RECORD_SCRIPTS:
            raise ValueError(f"script {name!r} registered twice")
        RECORD_SCRIPTS[name] = fn
        return fn

    return add


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def members(record) -> Column:
    """The keys of an object with their values, as a map; empty if it is none."""
    return F.coalesce(F.try_variant_get(_col(record), "$", _MAP), F.create_map().cast(_MAP))


def get_key(record, path: str, kind: str = "string") -> Column:
    """The value under a path such as ``a.b``; null if it is missing or of another kind."""
    return F.try_variant_get(_col(record), "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def set_key(record, path: str, value: Column) -> Column:
    """The record with ``value`` under the path; objects on the way are made."""
    head, _, rest = path.partition(".")
    here = members(record)
    if rest:
        value = set_key(F.try_element_at(here, F.lit(head)), rest, value)
    else:
        value = value.cast("variant")
    others = F.map_filter(here, lambda k, _: k != head)
    return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(head), value)))


def remove_key(record, path: str) -> Column:
    """The record without the path; as it is if the path is missing."""
    record = _col(record)
    head, _, rest = path.partition(".")
    here = members(record)
    if not rest:
        return F.when(F.map_contains_key(here, head), F.to_variant_object(F.map_filter(here, lambda k, _: k != head))).otherwise(record)
    inner = F.try_element_at(here, F.lit(head))
    known = F.try_variant_get(inner, "$", _MAP).isNotNull()
    return F.when(known, set_key(record, head, remove_key(inner, rest))).otherwise(record)


def add_tags(record, tags: Column) -> Column:
    """The record with more tags, each once."""
    old = F.coalesce(get_key(record, "tag", "array<string>"), F.array().cast("array<string>"))
    return set_key(record, "tag", F.array_distinct(F.concat(old, F.coalesce(tags, F.array().cast("array<string>")))))


def as_records(docs: DataFrame, tags: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(``id``, ``record``) of documents: the columns that are not null, and the
    tags in order, if there are any."""
    names = [c for c in docs.columns if c not in (id_col, "tag")]
    rows = docs
    if tags is not None:
        own = tags.groupBy(F.col("id").alias("_tid")).agg(F.array_sort(F.collect_set("tag")).alias("tag"))
        rows = docs.join(own, docs[id_col] == own["_tid"], "left").drop("_tid")
        names.append("tag")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("variant").alias("v")) for c in names])
    kept = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return rows.select(F.col(id_col).alias("id"), F.to_variant_object(kept).alias("record"))


def as_documents(records: DataFrame, like: DataFrame, id_col: str = "id") -> DataFrame:
    """Records as documents with the columns and types of ``like``; other keys
    are left out."""
    types = dict(like.dtypes)
    return records.select(*[F.col("id").cast(types[c]).alias(c) if c == id_col else get_key("record", c, types[c]).alias(c) for c in like.columns])


def record_tags(records: DataFrame) -> DataFrame:
    """The tag table of records: (``id``, ``tag``), each once."""
    return records.select("id", F.explode(F.array_distinct(get_key("record", "tag", "array<string>"))).alias("tag")).where(F.col("tag").isNotNull())


def run_script(records: DataFrame, script: Script | str) -> tuple[DataFrame, DataFrame]:
    """All records after a script (or a registered name), and those of them that
    it changed.  Records that it gives for unknown ids are left out."""
    script = RECORD_SCRIPTS[script] if isinstance(script, str) else script
    given = script(records).select(F.col("id").alias("_id"), F.col("record").alias("_record"))
    both = records.join(given, records["id"] == given["_id"], "left")
    now = F.coalesce("_record", "record")
    text = lambda c: F.col(c).cast("string")  # noqa: E731  keys of a VARIANT object are in order
    changed = F.col("_record").isNotNull() & ~text("_record").eqNullSafe(text("record"))
    rows = both.select("id", now.alias("record"), changed.alias("changed"))
    return rows.select("id", "record"), rows.where("changed").select("id", "record")


@record_script("hide_exif")
def hide_exif(records: DataFrame) -> DataFrame:
    """Without what a camera wrote about place and lens; a tag says so."""
    record = F.col("record")
    for key in ("exif_fnumber", "gps_latitude_dms", "gps_latitude_ref"):
        record = remove_key(record, key)
    return records.where(F.map_contains_key(members("record"), "exif_fnumber")).select(
        "id", add_tags(record, F.array(F.lit("private.#ff0000"))).alias("record"))


@record_script("pixels")
def pixels(records: DataFrame) -> DataFrame:
    """The number of pixels under ``media.pixels`` where both sides are known."""
    n = get_key("record", "width", "long") * get_key("record", "height", "long")
    return records.where(n.isNotNull()).select("id", set_key("record", "media.pixels", n).alias("record"))
