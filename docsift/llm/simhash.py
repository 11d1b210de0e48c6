"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that
differ in at most four bits differ in at most one bit of some segment, so they
share a variant of it: the segment with one bit taken out.  Every distinct
fingerprint is indexed under its 64 variants; equal variants meet by an
equality shuffle and are verified on all 64 bits.  A pair is reported only where
its segment differs in the taken bit, or in the first variant if its segments
are equal, so it is not found again in every other variant.

Equal fingerprints are one node.  In a task a short run of equal variants is
compared pairwise; a long one is searched from link to link, which reports a
spanning forest of its links, not all pairs.  A run that is longer than
``run_max`` is cut into chunks, and every pair of chunks becomes a task row
group of its own, so no group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import LOWER_SPACE_BYTES, chunked, field_type, materialise, only, texts_of, tidy
from docsift.llm.components import connected_components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHORT_RUN, RUN_MAX = 16, 1 << 14
BLOCK_BYTES = 4 << 20
HASHES = 1 << 16  # shingle hashes unpacked at a time

_START = np.zeros(64, dtype=np.uint64)
_WIDTH = np.zeros(64, dtype=np.uint64)
for _s, _w in SEGMENTS:
    _START[_s:_s + _w], _WIDTH[_s:_s + _w] = _s, _w


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text: a bit is set if it is set in
    over half the shingles' hashes; 0 without words."""
    words = [w for w in text.translate(LOWER_SPACE_BYTES).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + HASHES], ends[at:at + HASHES])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a signed long column
    ``out`` (which must be a new name); a null text has no words."""
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, BLOCK_BYTES, text_col):
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(where))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def variants(prints: DataFrame) -> DataFrame:
    """(``variant``, ``fp``): 64 rows a fingerprint.  The variant holds the
    number of the taken bit and the rest of its segment."""
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    start = F.when(F.col("bit") < 22, 0).when(F.col("bit") < 43, 22).otherwise(43)
    width = F.when(F.col("bit") < 22, 22).otherwise(21)
    rows = rows.withColumn("start", start).withColumn("width", width).selectExpr(
        "fp", "bit", "bit - start AS at", "shiftrightunsigned(fp, start) & (shiftleft(1L, width) - 1) AS segment")
    return rows.selectExpr(
        "shiftleft(cast(bit AS long), 32) | (segment & (shiftleft(1L, at) - 1)) | shiftleft(shiftright(segment, at + 1), at) AS variant",
        "fp")


def linked(x: np.ndarray, y: np.ndarray, bit: np.ndarray, bits: int) -> np.ndarray:
    """True where two fingerprints of one variant link and are to be reported
    there."""
    differ = x ^ y
    segment = (differ >> _START[bit]) & ((np.uint64(1) << _WIDTH[bit]) - np.uint64(1))
    here = np.where(segment == 0, _START[bit] == bit, True)
    return here & (np.bitwise_count(differ) <= bits)


def _forest_of_run(x: np.ndarray, bit: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one run: each fingerprint reached is
    compared with those not reached yet."""
    out, rest = [], x
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = linked(np.full(len(rest), one), rest, np.full(len(rest), bit), bits)
            found, rest = rest[hit], rest[~hit]
            if len(found):
                out.append((np.full(len(found), one), found))
                queue.extend(found)
    return out


def _links(variant: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal variants of some sorted rows."""
    bit = (variant >> np.int64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    length = np.diff(np.append(first, len(variant)))
    left, right = [], []
    short = np.repeat(length <= SHORT_RUN, length)
    for step in range(1, int(min(length.max(initial=0), SHORT_RUN))):
        at = np.flatnonzero((variant[step:] == variant[:-step]) & short[:-step])
        if not len(at):
            break
        at = at[linked(fp[at], fp[at + step], bit[at], bits)]
        left.append(fp[at])
        right.append(fp[at + step])
    for i in np.flatnonzero(length > SHORT_RUN):
        for a, b in _forest_of_run(fp[first[i]:first[i] + length[i]], int(bit[first[i]]), bits):
            left.append(a)
            right.append(b)
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_links(prints: DataFrame, bits: int = 4, run_max: int = RUN_MAX) -> DataFrame:
    """(``a``, ``b``): links whose components are those of all pairs of
    distinct fingerprints (column ``fp``) with at most ``bits`` (up to 5: one
    bit a segment of three, at least) differing bits."""
    if not 0 <= bits < 2 * len(SEGMENTS):
        raise ValueError(f"three segments find up to {2 * len(SEGMENTS) - 1} differing bits")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of whole runs (chunk -1), or the rows of a long run by chunk."""
        key, value, long_run, chunk = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            value = np.concatenate([value, batch.column(1).to_numpy().view(np.uint64)])
            while len(key):
                last = int(np.searchsorted(key, key[-1]))  # rows before the run that may go on
                if last:
                    done = int(np.searchsorted(key, long_run, side="right")) if long_run == key[0] else 0  # its end
                    if done:
                        yield _rows(key[:done], value[:done], chunk)
                    long_run, chunk = None, 0
                    yield _rows(*_links(key[done:last], value[done:last], bits), -1)
                    key, value = key[last:], value[last:]
                elif len(key) >= run_max:
                    chunk = chunk if long_run == key[0] else 0
                    long_run = key[0]
                    yield _rows(key[:run_max], value[:run_max], chunk)
                    key, value, chunk = key[run_max:], value[run_max:], chunk + 1
                else:
                    break
        if len(key):
            yield _rows(key, value, chunk) if long_run == key[0] else _rows(*_links(key, value, bits), -1)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the rows of one variant and pair of chunks."""
        held, now = [], None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                group = tuple(c[s] for c in columns[:3])
                if held and group != now:
                    yield _rows(*_links(np.full(sum(map(len, held)), now[0]), np.concatenate(held), bits), -1)
                    held = []
                now = group
                held.append(columns[3][s:e].view(np.uint64))
        if held:
            yield _rows(*_links(np.full(sum(map(len, held)), now[0]), np.concatenate(held), bits), -1)

    rows = variants(prints).repartition("variant").sortWithinPartitions("variant")
    found = materialise(rows.mapInArrow(tidy(scan), "a long, b long, chunk int"))
    links = found.where(F.col("chunk") < 0).select("a", "b")
    parts = found.where(F.col("chunk") >= 0).select(F.col("a").alias("variant"), F.col("b").alias("fp"), "chunk")
    sizes = parts.groupBy("variant").agg(F.max("chunk").alias("top"))
    pairs = parts.join(sizes, "variant").withColumn("other", F.explode(F.expr("sequence(0, top)"))).select(
        "variant", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "fp")
    group = ["variant", "low", "high"]
    crossed = pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(cross), "a long, b long, chunk int")
    return links.unionByName(crossed.select("a", "b")) if parts.limit(1).count() else links


def _rows(a: np.ndarray, b: np.ndarray, chunk: int) -> pa.RecordBatch:
    a, b = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b))
    return pa.RecordBatch.from_arrays([a, b, pa.array(np.full(len(a), chunk, dtype=np.int32))], names=["a", "b", "chunk"])


def fingerprint_components(prints: DataFrame, bits: int = 4) -> DataFrame:
    """For rows (``doc_id``, ``fp``): every distinct ``fp`` with its
    ``component`` (the smallest fingerprint of it) and ``component_id``, the
    smallest id reachable by links (null if none has an id)."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected_components(near_links(nodes.select("fp"), bits)).toDF("fp", "label")
    linked_nodes = nodes.join(labels, "fp")
    smallest = linked_nodes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    mapped = linked_nodes.join(smallest, "label").select("fp", "component_id", "label")
    alone = F.col("label").isNull()
    return nodes.join(mapped, "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("component"), F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without the
    near-duplicates: of every component the document with the smallest id stays.

    Rows that share an id are one document, of which the first by text stays.
    Of a component without any id the first row by text stays.  Null texts are
    texts without words; an empty table stays empty."""
    # whole rows in one struct, so that no column of theirs meets one of this function's
    boxed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = F.min_by("row", F.struct("text")).alias("row")
    prints = materialise(with_fingerprints(boxed.select("doc_id", "text"), shingle, out="fp").select("doc_id", "fp"))
    groups = materialise(fingerprint_components(prints, bits))
    kept = prints.join(groups, "fp").where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = boxed.join(kept, "doc_id", "left_semi")
    repeated = materialise(prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if not repeated.isEmpty():
        again = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first)
        named = named.join(repeated, "doc_id", "left_anti").select("doc_id", "row").unionByName(again)
    lost = materialise(groups.where(F.col("component_id").isNull()).select("fp", "component"))
    out = named.select("row")
    if not lost.isEmpty():
        nameless = with_fingerprints(boxed.where(F.col("doc_id").isNull()), shingle, out="fp")
        out = out.unionByName(nameless.join(lost, "fp").groupBy("component").agg(first).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def simhash_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable by links, itself included.

    A null text has no words and, like every text without words, fingerprint
    zero, which links like any other.  A null id is never the smallest; a
    component without ids has none.  Repeated rows are one node; an empty table
    gives no rows; other columns are not read."""
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    prints = materialise(with_fingerprints(rows, shingle, out="fp").select("doc_id", "fp"))
    # a table of its own, so that the join below may split a hot fingerprint
    groups = materialise(fingerprint_components(prints, bits).drop("component"))
    found = prints.join(groups, "fp")
    return found.select(F.col("doc_id").cast(field_type(docs, id_col)), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")
