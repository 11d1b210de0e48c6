"""Suffix-array dedup: bytes covered by a string that an earlier document has.

A byte goes if some string of ``SPAN`` bytes over it also starts in a document
with a smaller id.  A suffix array of all positions would shuffle every byte
dozens of times; here the suffixes are sampled by content instead.  In every
window of ``SPAN`` bytes the ``SEED``-byte string with the smallest hash is its
anchor, so equal windows have equal anchors at equal places, and only about one
position in fifteen is one.

1. Every task lists its anchors; those whose seed occurs in one document only
   are dropped (a shuffle of hashes, by hash bucket).
2. The others fetch the bytes around them (their suffix to depth ``SPAN``, and
   ``SPAN - SEED`` bytes before), again by bucket.
3. In a bucket the suffixes of equal seeds are sorted (``suffix_sort``), and so
   are the reversed bytes before them.  A window that begins ``o`` bytes before
   its anchor equals another if both sorted lists put the two in one run at
   depths ``SPAN - o`` and ``o``; the smallest document id of such a run
   decides.  Equal surroundings are sorted once.
4. The covered stretches go back to their documents, which cut them out.

Of documents with one text only that with the smallest id is compared with
others; the rest are covered whole.

Rows travel as packed blocks of arrays.  Buckets and blocks grow in number with
the input, so one bucket holds about ``bucket_bytes`` of text; fewer, larger
buckets pack better, more of them need less memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import byte_block, chunked, field_type, materialise, tidy
from docsift.llm.suffix_sort import sort_suffixes

SPAN, SEED = 50, 20
BEFORE = SPAN - SEED
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
SEGMENT = 1 << 20      # of a long text, looked at at a time
LOW40 = np.uint64((1 << 40) - 1)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed block; numbers byte plane by byte plane."""
    parts, head = [], struct.pack("<B", len(arrays))
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += struct.pack("<3sI", a.dtype.str[1:].encode().ljust(3), a.size)
        parts.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, at = data[0], 1
    heads = [struct.unpack_from("<3sI", data, at + 7 * i) for i in range(n)]
    at += 7 * n
    out = []
    for kind, size in heads:
        dtype = np.dtype("<" + kind.decode().strip())
        raw = np.frombuffer(data, np.uint8, size * dtype.itemsize, at)
        at += len(raw)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if dtype.itemsize > 1 else raw)
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    words = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    n, h = len(data) - SEED + 1, None
    for at in (0, 8, SEED - 8):
        h = words[at:at + n] if h is None else h ^ words[at:at + n]
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def text_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed hashes of the anchors of a text: of every window the
    seed with the smallest hash (all of them if tied)."""
    at, hashes = [], []
    for start in range(0, max(len(data) - SPAN + 1, 0), SEGMENT):
        part = data[start:start + SEGMENT + SPAN - 1]
        h, width = _seed_hashes(part), BEFORE + 1
        least = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint64)
        chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
        at.append(chosen + start)
        hashes.append(h[chosen])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    if len(at) and len(data) > SEGMENT:  # segments overlap by a window
        at, one = np.unique(at, return_index=True)
        hashes = hashes[one]
    return at, hashes


def block_of(doc_id: np.ndarray, blocks: int) -> np.ndarray:
    h = doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) >> np.uint64(20)).astype(np.int64) % blocks


def covered(bucket_hash: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with their surroundings (``BEFORE`` bytes before, ``SPAN``
    from the anchor on, zero-filled; ``before`` and ``after`` bytes of them
    exist): the first and the last ``o`` so that the window that begins ``o``
    bytes before the anchor also starts in a document with a smaller id
    (first > last: none)."""
    n = len(doc)
    low, high = np.full(n, SPAN), np.full(n, -1)
    if not n:
        return low, high
    # equal surroundings are one class: hashed, then compared byte by byte
    mix = bucket_hash ^ (before.astype(np.uint64) << np.uint64(8)) ^ after.astype(np.uint64)
    words = text.view("<u8")
    for i in range(words.shape[1]):
        mix = (mix ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    _, one, of = np.unique(mix, return_index=True, return_inverse=True)
    odd = np.flatnonzero((text != text[one[of]]).any(axis=1) | (bucket_hash != bucket_hash[one[of]])
                         | (before != before[one[of]]) | (after != after[one[of]]))
    if len(odd):  # hash collisions become classes of their own
        of = of.copy()
        of[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    # of a class, every document but the smallest is covered wherever it has a window
    full_low, full_high = np.maximum(SPAN - after, 0), np.minimum(before, BEFORE)
    later = doc > least[of]
    low[later], high[later] = full_low[later], full_high[later]

    # the smallest documents of the classes are compared by their sorted suffixes
    group, b, a = bucket_hash[one], before[one], after[one]
    right, prefix = sort_suffixes(group, text[one, BEFORE:])
    left, suffix = sort_suffixes(group, text[one, :BEFORE][:, ::-1])
    first, last = np.full(len(one), SPAN), np.full(len(one), -1)
    run_right, run_left = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    for o in range(BEFORE + 1):
        run_right[right] = np.cumsum(prefix < SPAN - o)
        run_left[left] = np.cumsum(suffix < o) if o else 0
        has = np.flatnonzero((b >= o) & (a >= SPAN - o))
        if not len(has):
            continue
        key = run_right[has] * (len(one) + 1) + run_left[has]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], has[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        if len(start) == len(key):
            continue
        smallest = np.repeat(np.minimum.reduceat(least[rows], start), np.diff(np.append(start, len(rows))))
        hit = rows[smallest < least[rows]]
        first[hit], last[hit] = np.minimum(first[hit], o), o
    own = ~later
    low[own], high[own] = first[of[own]], last[of[own]]
    return low, high


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(key, rows) of sorted rows whose first column is the key."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield now, rows


def _split(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(value, arrays) of the rows of each value of ``key``, in order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else [0]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield int(key[s]), [a[order[s:e]] for a in arrays]


def _block(kind: int, key: int, other: int, data: bytes, rows: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([kind], pa.int32()), pa.array([other]), pa.array([data], pa.binary()),
                                       pa.array([rows], pa.binary())], names=["key", "kind", "other", "data", "rows"])


BLOCKS = "key long, kind int, other long, data binary, rows binary"


def _packed_documents(rows: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """Documents by block: ids, text lengths and texts, kind 1; the columns of
    ``rows`` behind the first two travel along as an Arrow stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, block_bytes):
            ids, (data, offsets) = batch.column(0).to_numpy(), byte_block(batch.column(1))
            for block, (rows_of,) in _split(block_of(ids, blocks), np.arange(len(ids))):
                texts = [data[offsets[i]:offsets[i + 1]] for i in rows_of.tolist()]
                yield _block(1, block, 0, pack(ids[rows_of], np.array([len(t) for t in texts], np.int64),
                                                np.concatenate(texts), level=5), _stream(batch, rows_of))

    return rows.mapInArrow(tidy(run), BLOCKS)


def _stream(batch: pa.RecordBatch, rows: np.ndarray) -> bytes | None:
    """The carried columns of some rows."""
    if batch.num_columns == 2:
        return None
    carried = batch.select(range(2, batch.num_columns)).take(pa.array(rows))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, carried.schema) as writer:
        writer.write_batch(carried)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _with_documents(blocks: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, found, carried row) of each document; ``found``: what was
    sent to its block for its id and tag, as arrays, or None."""
    now, sent = None, []
    table = None
    for batch in blocks:
        for key, kind, other, data, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                now, sent, table = key, [], None
            if kind == 0:
                arrays = unpack(data)
                sent.append([*arrays, np.full(len(arrays[0]), other, dtype=np.int64)])
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*sent)] if sent else None
                sent = []
                if table is not None:
                    order = np.lexsort((table[1], table[0]))
                    table = [x[order] for x in table]
            ids, lengths, texts = unpack(data)
            ends = np.cumsum(lengths)
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all() if rows is not None else None
            for i, (doc, s, e) in enumerate(zip(ids.tolist(), (ends - lengths).tolist(), ends.tolist())):
                text, found = texts[s:e], None
                if table is not None:
                    lo, hi = np.searchsorted(table[0], doc), np.searchsorted(table[0], doc, side="right")
                    if lo < hi:
                        tag = zlib.crc32(text)
                        a, b = np.searchsorted(table[1][lo:hi], [tag, tag + 1])
                        if a < b:
                            found = [x[lo + a:lo + b] for x in table]
                yield doc, text, found, (rows, i)


def later_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, size) of the texts that a smaller id has too."""
    meta = rows.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("size"),
                       F.crc32("text").alias("tag")).where(F.col("size") >= SPAN)
    first = meta.groupBy("digest", "size").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # a table of its own, so that the join below may split a hot text
    first = materialise(first.where(F.col("first_id") < F.col("last_id")))
    return meta.join(first, ["digest", "size"]).where(F.col("doc_id") > F.col("first_id")).select("doc_id", "tag", "size")


def _copy_blocks(copies: DataFrame, buckets: int, stretches: bool) -> DataFrame:
    """Copies by block: as stretches over the whole text, or as anchors of
    bucket -1, which say that the text needs none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, size = (c.to_numpy() for c in batch.columns)
            none, tag = np.zeros(len(doc), dtype=np.int64), tag.astype(np.uint32)
            rest = (none, size) if stretches else (none.astype(np.uint32), none.astype(np.uint64))
            for block, found in _split(block_of(doc, buckets), doc, tag, *rest):
                yield _block(0, block, 0 if stretches else -1, pack(*found))

    return copies.mapInArrow(tidy(run), BLOCKS)


def repeated_stretches(rows: DataFrame, copies: DataFrame, buckets: int, bucket_bytes: int) -> DataFrame:
    """Blocks (kind 0) of document id, text tag, start and end of stretches
    that an earlier document has; ``rows``: (doc_id, text), no nulls."""
    records = max(bucket_bytes >> 7, 1)  # surroundings packed at a time

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, CHUNK_BYTES):
            ids, (data, offsets) = batch.column(0).to_numpy(), byte_block(batch.column(1))
            at, h, sizes, tags = [], [], [], []
            for i in range(len(ids)):
                text = data[offsets[i]:offsets[i + 1]]
                a, x = text_anchors(text)
                at.append(a)
                h.append(x)
                sizes.append(len(a))
                tags.append(zlib.crc32(text) if len(a) else 0)
            at, h = np.concatenate(at).astype(np.uint32), np.concatenate(h)
            of = np.repeat(np.arange(len(ids)), sizes)
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            tags = np.array(tags, dtype=np.uint32)
            for b, (hashes, doc, pos) in _split(bucket, h & LOW40, of, at):
                yield _block(0, b, 0, pack(hashes, np.diff(ids[doc], prepend=0), tags[doc], pos))

    def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of seeds that at least two documents have, by document block."""
        for bucket, blocks in _grouped(batches):
            parts = [unpack(row[3]) for row in blocks]
            h, tag, pos = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
            doc = np.concatenate([np.cumsum(p[1]) for p in parts])
            del parts
            order = np.argsort(h, kind="stable")
            h, doc, tag, pos = h[order], doc[order], tag[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            keep = np.repeat(shared, np.diff(np.append(first, len(h))))
            h, doc, tag, pos = h[keep], doc[keep], tag[keep], pos[keep]
            for block, found in _split(block_of(doc, buckets), doc, tag, pos, h):
                yield _block(0, block, bucket, pack(*found))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around the kept anchors, by bucket again."""
        held, n = [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            for bucket, found in _split(columns[0], *columns[1:]):
                order = np.argsort(found[0], kind="stable")  # equal texts side by side pack well
                found = [f[order] for f in found]
                yield _block(0, bucket, 0, pack(*found[:-1], found[-1].ravel(), level=3))

        reach = np.arange(-BEFORE, SPAN)
        for doc, text, found, _ in _with_documents(batches):
            if found is None or found[4].min() < 0:  # nothing shared, or a copy
                continue
            _, tag, pos, h, bucket = found
            pos = pos.astype(np.int64)
            for s in range(0, len(pos), records):
                p = pos[s:s + records]
                where = p[:, None] + reach
                inside = (where >= 0) & (where < len(text))
                around = np.where(inside, text[np.clip(where, 0, len(text) - 1)], 0).astype(np.uint8)
                held.append((bucket[s:s + records], h[s:s + records], np.full(len(p), doc), tag[s:s + records], p.astype(np.uint32),
                             np.minimum(p, BEFORE).astype(np.uint8), np.minimum(len(text) - p, SPAN).astype(np.uint8), around))
                n += len(p)
                if n >= records:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Covered stretches, by document block."""
        for _, blocks in _grouped(batches):
            parts = [unpack(row[3]) for row in blocks]
            h, doc, tag, pos, before, after, text = (np.concatenate([p[i] for p in parts]) for i in range(7))
            del parts, blocks
            before, after = before.astype(np.int64), after.astype(np.int64)
            low, high = covered(h, doc, before, after, text.reshape(-1, BEFORE + SPAN))
            hit = np.flatnonzero(low <= high)
            start = pos[hit].astype(np.int64) - high[hit]
            end = pos[hit].astype(np.int64) - low[hit] + SPAN
            for block, found in _split(block_of(doc[hit], buckets), doc[hit], tag[hit], start, end):
                yield _block(0, block, 0, pack(*found))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "key").sortWithinPartitions("key", "kind")

    anchors = dealt(rows.mapInArrow(tidy(list_anchors), BLOCKS)).mapInArrow(tidy(keep_shared), BLOCKS)
    parts = anchors.unionByName(_packed_documents(rows, buckets, bucket_bytes)).unionByName(_copy_blocks(copies, buckets, False))
    around = dealt(parts).mapInArrow(tidy(surroundings), BLOCKS)
    return dealt(around).mapInArrow(tidy(compare), BLOCKS).unionByName(_copy_blocks(copies, buckets, True))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching stretches."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
                   carry: bool = False, as_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``spans`` (the maximal removed runs, as start and end) and ``kept`` (the
    bytes that stay, joined; with ``as_text`` as a string, without the bytes of
    characters that were cut in two).  With ``carry`` the other columns of the
    input are in the struct ``row``.

    A null text is an empty one.  A row with a null id stands outside the order
    of ids: nothing is removed from it and it covers nothing.  Rows with one id
    do not cover each other.  Texts of less than ``SPAN`` bytes stay whole; an
    empty table gives no rows.  Ids are integers."""
    others = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *row)
    known = rows.where(F.col("doc_id").isNotNull())
    plain = known.select("doc_id", "text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-total // bucket_bytes))
    stretches = repeated_stretches(plain, materialise(later_copies(plain)), buckets, bucket_bytes)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
              T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    out = T.StructType(fields + ([rows.schema["row"]] if others else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried, n = [], [], 0
        for doc, text, found, place in _with_documents(batches):
            starts, ends, kept = [], [], text
            if found is not None:
                s, e = merge_spans(found[2], found[3])
                stay = np.ones(len(text), dtype=bool)
                for a, b in zip(s.tolist(), e.tolist()):
                    stay[a:b] = False
                starts, ends, kept = s.tolist(), e.tolist(), text[stay]
            held.append((doc, len(text), len(text) - len(kept), starts, ends,
                         kept.tobytes().decode("utf-8", "ignore") if as_text else kept.tobytes()))
            carried.append(place)
            n += len(kept) + 64
            if n >= CHUNK_BYTES:
                yield _out(held, carried, as_text)
                held, carried, n = [], [], 0
        if held:
            yield _out(held, carried, as_text)

    both = stretches.unionByName(_packed_documents(known, buckets, bucket_bytes)).repartition(buckets, "key").sortWithinPartitions("key", "kind")
    found = both.mapInArrow(tidy(cut), out)
    nameless = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<long>").alias("starts"), F.array().cast("array<long>").alias("ends"), (F.col("text") if as_text else F.col("text").cast("binary")).alias("kept"),
        *(["row"] if others else []))
    result = found.unionByName(nameless)
    return result.select(F.col("doc_id").cast(field_type(docs, id_col)), "n_bytes", "n_removed",
                         F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept",
                         *(["row"] if others else []))


def _out(rows: list[tuple], carried: list[tuple], as_text: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string() if as_text else pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    if carried[0][0] is not None:
        parts, at = [], 0
        while at < len(carried):  # runs of rows of one table
            stop = at
            while stop < len(carried) and carried[stop][0] is carried[at][0]:
                stop += 1
            parts.append(carried[at][0].slice(carried[at][1], stop - at).column("row"))
            at = stop
        arrays.append(pa.chunked_array([c for p in parts for c in p.chunks]).combine_chunks())
        names.append("row")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with the repeats cut out of ``text_col``
    (``length_col`` becomes its length in characters); bytes of a character
    that was cut in two go as well.  A null text comes back empty."""
    texts = remove_repeats(docs, id_col, text_col, bucket_bytes, carry=True, as_text=True)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("kept").alias(c))
        elif c == id_col:
            columns.append(F.col("doc_id").alias(c))
        elif c == length_col:
            columns.append(F.length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return texts.select(*columns)
