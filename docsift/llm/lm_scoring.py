"""Language-model scores of texts, and a unigram score beside them.

The model (``mixing_model``) learns by counting over all training texts: first
what follows each byte and each pair of bytes, for its codes, then the symbols
in its hashed contexts.  Contexts go with their symbols, by key and once per
chunk of texts, to the bucket that sums them, and the predictions come back to
the chunk in the same order; their number grows with the texts and no table of
them is held whole anywhere.  Scoring refines the mixing per text, so a score depends on the
model and the text alone.

The unigram score needs the training count of every word.  Words go, by hash and
once per chunk of texts, to the bucket that sums them, and the sums come back to
the chunk in the same order; no vocabulary is held whole anywhere.  Words are
told apart by their 64-bit hash.

Texts are first packed into chunks, written to the shared folder, so that all
passes read the same chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm import mixing_model as model
from docsift.llm.common import LOWER_SPACE_BYTES, byte_block, chunked, crc32_remainder, field_type, materialise, only, tidy
from docsift.llm.suffix_dedup import pack, unpack

CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
SMOOTH = 0.1
ROWS = "key long, kind int, other long, data binary"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
# keeps the first 0 to 8 of eight bytes
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _row(key: int, kind: int, other: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([kind], pa.int32()), pa.array([other], pa.int64()),
                                       pa.array([data], pa.binary())], names=["key", "kind", "other", "data"])


def _pack_chunks(rows: DataFrame) -> DataFrame:
    """Chunks (kind 1) of ids, flags (1 no id, 2 held out, 4 learned from),
    lengths and texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def flush():
            return _row(number, 1, 0, pack(*(np.concatenate(x) for x in zip(*held))))

        for batch in chunked(batches, CHUNK_BYTES):
            data, offsets = byte_block(batch.column(1))
            ids, flags = batch.column(0), batch.column(2).to_numpy().astype(np.uint8)
            held.append((ids.fill_null(0).to_numpy(), flags, np.diff(offsets), data))
            n += len(data) + 16 * batch.num_rows
            if n >= CHUNK_BYTES:
                yield flush()
                held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return rows.mapInArrow(tidy(run), ROWS)


def _texts(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, flags, lengths, raw = unpack(data)
    raw, ends = raw.tobytes(), np.cumsum(lengths)
    return ids, flags, [raw[s:e] for s, e in zip((ends - lengths).tolist(), ends.tolist())]


def _blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) + 8
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _learned(data: bytes) -> list[bytes]:
    _, flags, texts = _texts(data)
    return [t for t, f in zip(texts, flags.tolist()) if f & 4]


def _train_code(chunks: DataFrame) -> model.Code:
    """Codes from the symbols after each byte and after the commonest pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(model.SYMBOLS << 16, dtype=np.uint32)
        for batch in batches:
            for data in batch.column(3).to_pylist():
                for texts in _blocks(_learned(data)):
                    model.pair_counts(texts, counts)
        key = np.flatnonzero(counts)
        pair, symbol = key // model.SYMBOLS, key % model.SYMBOLS
        for s in range(0, len(key), 10000):
            part = slice(s, s + 10000)
            yield pa.RecordBatch.from_arrays([pa.array(pair[part].astype(np.int32)), pa.array(symbol[part].astype(np.int32)),
                                              pa.array(counts[key[part]].astype(np.int64))], names=["pair", "symbol", "n"])

    counted = materialise(chunks.mapInArrow(tidy(run), "pair int, symbol int, n long").groupBy("pair", "symbol").agg(F.sum("n").alias("n")))
    singles = np.zeros((256, model.SYMBOLS), dtype=np.int64)
    for r in counted.groupBy(F.shiftright("pair", 8).alias("last"), "symbol").agg(F.sum("n").alias("n")).collect():  # 256 x 257 at most
        singles[r["last"], r.symbol] = r.n
    common = counted.groupBy("pair").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "pair").limit(model.PAIRS)
    pairs: dict[int, np.ndarray] = {}
    for r in counted.join(F.broadcast(common), "pair").collect():  # PAIRS x 257 at most
        pairs.setdefault(r.pair, np.zeros(model.SYMBOLS, dtype=np.int64))[r.symbol] = r.n
    return model.huffman_code(singles, pairs)


def _chunk_keys(code: model.Code, flags: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct context keys of a chunk, in order, and their training counts."""
    learned, other = ([t for t, f in zip(texts, (flags & 4).tolist()) if bool(f) == want] for want in (True, False))
    return model.count_keys(code, [*((b, True) for b in _blocks(learned)), *((b, False) for b in _blocks(other))])


def _key_parts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of a context's hash: where each begins in ``keys``,
    and the end."""
    bounds = [(b << 64) // buckets >> 1 + model.ROW_BITS << 1 + model.ROW_BITS for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, dtype=np.uint64)), [len(keys)]])


def _path_predictions(chunks: DataFrame, code, buckets: int) -> DataFrame:
    """Predictions on the paths of every chunk's context keys, in their order,
    by chunk (kind -1; ``other`` is the bucket)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                _, flags, texts = _texts(data)
                keys, counts = _chunk_keys(code.value, flags, texts)
                parts = _key_parts(keys, buckets)
                for b in np.flatnonzero(np.diff(parts)).tolist():
                    mine = slice(parts[b], parts[b + 1])
                    yield _row(b, 0, chunk, pack(np.diff(keys[mine] >> np.uint64(1), prepend=np.uint64(0)), counts[mine].astype(np.uint32)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            distinct, place = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([n for _, _, n in held]), minlength=len(distinct))
            values = model.path_predictions(code.value, distinct, total)
            length = model.key_lengths(code.value, distinct)
            start = (np.cumsum(length) - length).astype(np.int32)
            at = 0
            for chunk, k, _ in held:
                mine = place[at:at + len(k)]
                yield _row(chunk, -1, now, pack(values[model.runs_of(start[mine], length[mine])]))
                at += len(k)

        now, held = None, []
        for batch in batches:
            for bucket, chunk, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if bucket != now:
                    if held:
                        yield from close()
                    now, held = bucket, []
                steps, counts = unpack(data)
                held.append((chunk, np.cumsum(steps) << np.uint64(1), counts))
        if held:
            yield from close()

    sent = chunks.mapInArrow(tidy(send), ROWS).repartition(buckets, "key").sortWithinPartitions("key")
    return sent.mapInArrow(tidy(add), ROWS)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and the words of each text.
    A word enters eight bytes at a time; words of one length up to eight bytes
    never share a hash."""
    room = np.frombuffer((b" ".join(texts) + b" " * 8).translate(LOWER_SPACE_BYTES), dtype=np.uint8)
    letter = room != 32
    start, end = (np.flatnonzero(x) + 1 for x in (letter[1:] > letter[:-1], letter[1:] < letter[:-1]))
    if letter[0]:
        start = np.concatenate([[0], start])
    eight = np.ndarray((len(room) - 7,), dtype="<u8", buffer=room, strides=(1,))
    h, left, place, active = (end - start).astype(np.uint64) * _ODD[0], end - start, start, None
    while True:
        x = eight[place] & _KEEP[np.minimum(left, 8)]
        x = (x ^ (h if active is None else h[active])) * _ODD[0]
        x ^= x >> np.uint64(32)
        x *= _ODD[1]
        x ^= x >> np.uint64(29)
        if active is None:
            h, active = x, np.arange(len(x))
        else:
            h[active] = x
        more = left > 8
        active, place, left = active[more], place[more] + 8, left[more] - 8
        if not len(active):
            break
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    stops = np.searchsorted(start, np.cumsum(sizes))
    return h, np.diff(stops, prepend=0)


def _distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of some texts, in order, the place of every word
    among them, and the words of each text."""
    words, sizes = word_hashes(texts)
    found, number = model.numbered(words)
    order = np.argsort(found)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[number], sizes


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _word_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Training counts of every chunk's words, by chunk (kind 0; ``other`` is
    the bucket), and per bucket its distinct training words (kind 2) and
    training tokens (kind 3) under key -1."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                _, flags, texts = _texts(data)
                hashes, place, sizes = _distinct_words(texts)
                counts = np.bincount(place, weights=np.repeat((flags & 4) > 0, sizes), minlength=len(hashes))
                bucket = _bucket(hashes, buckets)
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    yield _row(b, 0, chunk, pack(hashes[mine], counts[mine].astype(np.uint32)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            hashes = np.concatenate([h for _, h, _ in held])
            distinct, place = np.unique(hashes, return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([n for _, _, n in held]), minlength=len(distinct)).astype(np.int64)
            yield _row(-1, 2, int((total > 0).sum()), b"")
            yield _row(-1, 3, int(total.sum()), b"")
            at = 0
            for chunk, h, _ in held:
                yield _row(chunk, 0, now, pack(total[place[at:at + len(h)]]))
                at += len(h)

        now, held = None, []
        for batch in batches:
            for bucket, chunk, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if bucket != now:
                    if held:
                        yield from close()
                    now, held = bucket, []
                held.append((chunk, *unpack(data)))
        if held:
            yield from close()

    sent = chunks.mapInArrow(tidy(send), ROWS).repartition(buckets, "key").sortWithinPartitions("key")
    return materialise(sent.mapInArrow(tidy(add), ROWS))


def score_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
                   bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out`` (crc32(id) mod ``folds``
    is 0), ``n_tokens`` (words and one end), ``n_known`` (those with a training
    count), ``train_tokens``, ``base_score`` (unigram log10 probability of the
    tokens), ``score`` (the model's log10 probability of the lower-cased text
    and its end) and ``n_bytes``.

    Training texts are those with an id outside the held-out fold; a null id is
    neither learned from nor held out.  A null text is an empty one: its end
    alone.  Repeated rows are learned and scored each; an empty table gives no
    rows; without training texts all codes are even.  Other columns are not
    read.  Ids are integers."""
    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    rest = crc32_remainder(F.col("doc_id"), folds)
    flag = F.when(F.col("doc_id").isNull(), 1).when(rest == 0, 2).otherwise(4).cast("int")
    rows = rows.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), flag.alias("flag"))
    spark = docs.sparkSession
    chunks = materialise(_pack_chunks(rows))
    code = spark.sparkContext.broadcast(_train_code(chunks))
    train_texts, total = rows.agg(F.coalesce(F.sum(F.when(F.col("flag") == 4, 1)), F.lit(0)),
                                  F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_chunks = chunks.count()
    buckets = max(4, -(-total // bucket_bytes))
    counts = _word_counts(chunks, buckets)
    known = dict(counts.where(F.col("key") == -1).groupBy("kind").agg(F.sum("other")).collect())
    tokens = known.get(3, 0) + train_texts
    vocabulary = known.get(2, 0) + (train_texts > 0)
    whole = tokens + SMOOTH * (vocabulary + 1)
    start = model.start_weights()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("n_bytes", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies: dict[int, np.ndarray] = {}
        paths: dict[int, np.ndarray] = {}
        now = None
        for batch in batches:
            for chunk, kind, other, data in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    now, replies, paths = chunk, {}, {}
                if kind == -1:
                    paths[other] = unpack(data)[0].view(np.int8)
                    continue
                if kind == 0:
                    replies[other] = unpack(data)[0]
                    continue
                ids, flags, texts = _texts(data)
                hashes, place, sizes = _distinct_words(texts)
                bucket, c = _bucket(hashes, buckets), np.zeros(len(hashes), dtype=np.int64)
                for b, n in replies.items():
                    c[bucket == b] = n
                logs = np.log10((c + SMOOTH) / whole)
                end = math.log10((train_texts + SMOOTH) / whole)
                text_of = np.repeat(np.arange(len(texts)), sizes)
                base = np.bincount(text_of, weights=logs[place], minlength=len(texts)) + end
                seen = np.bincount(text_of, weights=c[place] > 0, minlength=len(texts)).astype(np.int64) + (train_texts > 0)
                values = np.concatenate([paths[b] for b in sorted(paths)])
                bits = model.score_texts(code.value, list(_blocks(texts)), lambda keys: values, start)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=(flags & 1).astype(bool)), pa.array((flags & 2).astype(bool)),
                    pa.array(sizes + 1), pa.array(seen),
                    pa.array(np.full(len(texts), tokens, dtype=np.int64)), pa.array(base), pa.array(-bits * math.log10(2)),
                    pa.array(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))], names=schema.names)

    both = chunks.unionByName(counts.where(F.col("key") >= 0)).unionByName(_path_predictions(chunks, code, buckets))
    dealt = both.repartition(max(n_chunks, 1), "key").sortWithinPartitions("key", "kind")
    return dealt.mapInArrow(tidy(score), schema).withColumn("doc_id", F.col("doc_id").cast(field_type(docs, id_col)))
