"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents that it reads, so nothing is shuffled.  A
document is cut into whole windows of the longest tier and one remainder,
which is routed to the shortest tier that holds it.  The tiers are packed from
the longest down: a window starts with a piece of its own tier, and its gap is
filled with pieces of the shorter tiers, the largest that fits first; when none
fits, the shortest remaining piece is cut at the gap and its tail goes back to
its tier.  Every window is therefore full, and since tiers are powers of two,
none needs padding.  What is left of a block of documents (less than the
shortest tier) moves on to the next block; at the end of a partition it is
emitted as windows of decreasing powers of two.  The windows of a block are
spread over step groups, longest first onto the emptiest group, so that all
steps hold about the same number of tokens.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docsift.llm.common import chunked, field_type, only, tidy, tokenizer_path

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 2 << 20
# Characters on which both libraries split words alike; other texts, and texts
# with very long unbroken runs, go to the slower library (same ids).
_OTHER = re.compile("[^\t\n\r -~\xa1-\xac\xae-ſ–—‘-„…€]")
LONG_RUN = 2000


@functools.lru_cache(maxsize=1)
def _exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(VOCABULARY))


@functools.lru_cache(maxsize=1)
def _fast():
    """The same vocabulary as ranks, for the faster library; None if the two
    files disagree on any id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = _exact().get_vocab(with_added_tokens=False)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {
        b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in printable)}
    same = all(vocabulary.get("".join(shown[b] for b in token)) == rank for token, rank in ranks.items())
    if not same:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _special() -> tuple[str, ...]:
    return tuple(t.content for t in _exact().get_added_tokens_decoder().values())


def _unbroken(text: str) -> bool:
    """True if the text has a run of LONG_RUN blanks or of other characters."""
    if len(text) < LONG_RUN:
        return False
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    change = np.flatnonzero(np.diff(data <= 32, prepend=False, append=False))
    return bool(np.diff(change, prepend=0, append=len(data)).max() >= LONG_RUN)


def token_ids(text: str) -> np.ndarray:
    """Ids of one text, as the vocabulary's own library gives them."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    fast = _fast()
    if (fast is not None and (text.isascii() or not _OTHER.search(text)) and not any(s in text for s in _special())
            and "\x00" not in text and not _unbroken(text)):
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
    return np.array(_exact().encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class _Pool:
    """Pieces waiting for a window, by length."""

    def __init__(self, longest: int):
        self.by = [[] for _ in range(longest + 1)]
        self.mask = 0
        self.tokens = 0

    def put(self, doc, start: int, length: int) -> None:
        self.by[length].append((doc, start))
        self.mask |= 1 << length
        self.tokens += length

    def take(self, length: int):
        stack = self.by[length]
        piece = stack.pop()
        if not stack:
            self.mask &= ~(1 << length)
        self.tokens -= length
        return piece

    def largest(self, most: int) -> int:
        """Length of the longest piece of at most ``most`` tokens, or 0."""
        return max((self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def _fill(pool: _Pool, window: int) -> list:
    """One full window; the pool holds at least that many tokens."""
    pieces, gap = [], window
    while gap:
        length = pool.largest(gap)
        if length:
            doc, start = pool.take(length)
            pieces.append((doc, start, length))
            gap -= length
        else:
            length = pool.shortest()
            doc, start = pool.take(length)
            pieces.append((doc, start, gap))
            pool.put(doc, start + gap, length - gap)
            gap = 0
    return pieces


def pack_pool(pool: _Pool, tiers: list[int], last: bool) -> list[list]:
    """Windows of every tier, longest tier first; with ``last`` the rest too."""
    windows = []
    for k, tier in enumerate(tiers):
        lower = tiers[k + 1] if k + 1 < len(tiers) else 0
        # a piece of this tier (or a longer one that a thin pool left) opens each window
        while pool.tokens >= tier and pool.mask >> (lower + 1):
            windows.append(_fill(pool, tier))
    while last and pool.tokens:
        windows.append(_fill(pool, 1 << (pool.tokens.bit_length() - 1)))
    return windows


def balance(sizes: list[int], step_tokens: int) -> list[int]:
    """Step of every window: as many steps as full ones are needed, longest
    window first onto the step with the fewest tokens."""
    steps = max(1, -(-sum(sizes) // step_tokens))
    heap, out = [(0, s) for s in range(steps)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, step = heap[0]
        out[i] = step
        heapq.heapreplace(heap, (load + sizes[i], step))
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
                   shortest: int = 256, end_id: int = 1, step_tokens: int = 16 * 2048,
                   block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of packed windows, one row each: ``doc_id``, ``start`` (tokens
    of its document before it), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset``
    (within the window), ``sequence_tokens`` (always a power of two of at most
    ``window``) and ``step_group``.

    ``window`` and ``shortest`` are powers of two.  A null text is an empty
    one: its document is the end id alone.  A null id stays null; repeated rows
    are packed each; an empty table gives no rows; other columns are not read.
    A window never mixes partitions, so ids of windows and steps hold the
    partition number in their upper bits.  Memory: ``block_tokens`` ids and one
    document."""
    tiers = [1 << b for b in range(window.bit_length() - 1, shortest.bit_length() - 2, -1)]
    if tiers[0] != window or tiers[-1] != shortest:
        raise ValueError("window and shortest must be powers of two")
    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, id_col)), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("sequence_tokens", T.LongType()),
        T.StructField("step_group", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        pool, held, sequence, group = _Pool(window), 0, 0, 0
        full: list[list] = []

        def flush(id_type, last: bool):
            nonlocal sequence, group, full
            windows = full + pack_pool(pool, tiers, last)
            full = []
            sizes = [sum(p[2] for p in w) for w in windows]
            steps = balance(sizes, step_tokens)
            for at in range(0, len(windows), 512):
                rows = []
                for i in range(at, min(at + 512, len(windows))):
                    offset = 0
                    for (doc_id, ids), start, length in windows[i]:
                        rows.append((doc_id, start, length, ids[start:start + length].tobytes(), len(ids), base + sequence + i,
                                     offset, sizes[i], base + group + steps[i]))
                        offset += length
                columns = list(zip(*rows))
                types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)
            sequence += len(windows)
            group += max(steps, default=-1) + 1

        id_type = None
        for batch in chunked(batches, BLOCK_BYTES):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                doc, cut = (doc_id, ids), len(ids) - len(ids) % window
                full.extend([(doc, s, window)] for s in range(0, cut, window))
                if cut < len(ids):
                    pool.put(doc, cut, len(ids) - cut)
                held += len(ids)
                if held >= block_tokens:
                    yield from flush(id_type, False)
                    held = 0
        if id_type is not None:
            yield from flush(id_type, True)

    rows = only(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(tidy(run), schema)
