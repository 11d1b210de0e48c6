"""Spelling variants: words one edit apart, found by banded dynamic programming
over sorted word lists.

Two words one edit apart share all before the edit and all behind it.  So they
share the first half of the shorter one, or else its second half, and every
word goes, for both lengths that the shorter one can have, to a group by first
half and, written backwards, to one by second half.  A group that grows beyond
``group_words`` is dealt anew by the word without the one place of the edit,
which bounds it by the alphabet; no pair is lost.

In a group the words are a sorted list with the longest common prefix (LCP) of
neighbours.  The edit matrix of a query against a word of the list depends only
on the word's prefix, so its rows (three cells of a band: more are more than one
edit away) are computed once for each run of words that share the prefix; runs
split where the LCP ends.  A run whose row exceeds one edit is skipped as a
whole.  All queries and runs advance together, one letter a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialise, only, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAR = 9          # a cell outside of the matrix
QUERIES = 4096   # queries that advance together


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, damage: int | None = 31,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``word``, ``n``): the words with ``min_length`` code points that occur
    ``min_count`` times in all whole texts.  Words are the longest runs of
    ``A-Za-z`` and U+00C0 to U+00FF, A-Z in lower case.

    With ``damage``, a run loses its code point ``h % length`` if ``damage``
    divides ``h``, the crc32 of ``<id>:<run>``: known spelling errors at a known
    rate.  A null text has no words; a null id counts as empty text."""
    rows = only(docs, id_col, text_col).toDF("id", "text")
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    # a shorter run is no word, damaged or not
    rows = rows.select("id", F.explode(F.filter(runs, lambda w: F.length(w) >= min_length)).alias("word"))
    if damage is not None:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + F.lit(2)))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
    return (rows.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


class SortedWords:
    """Groups of distinct Latin-1 words, each group sorted, one behind the other."""

    def __init__(self, words: list[bytes], group: np.ndarray):
        self.n, self.group = len(words), group
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.codes = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int16)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.lcp = self._lcp()
        inner = np.flatnonzero(self.lcp >= 0)
        # places where words part, by LCP and place, so that those of a run are one range
        self.marks = np.sort(self.lcp[inner] * (self.n + 1) + inner)

    def _lcp(self) -> np.ndarray:
        """LCP of each word with the one before it; -1 at the start of a group."""
        lcp = np.full(self.n, -1, dtype=np.int64)
        active, depth = np.flatnonzero(np.diff(self.group) == 0) + 1, 0
        while len(active):
            lcp[active] = depth
            more = np.minimum(self.length[active], self.length[active - 1]) > depth
            active = active[more]
            active = active[self.codes[self.start[active] + depth] == self.codes[self.start[active - 1] + depth]]
            depth += 1
        return lcp

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all pairs of a group that are one edit apart, both ways."""
        first = np.flatnonzero(self.lcp < 0)
        stop = np.append(first[1:], self.n)
        of = np.cumsum(self.lcp < 0) - 1
        shared = np.minimum.reduceat(np.where(self.lcp < 0, np.iinfo(np.int64).max, self.lcp), first) if self.n else first
        queries = np.flatnonzero((stop - first)[of] > 1)
        found = []
        for s in range(0, len(queries), QUERIES):
            q = queries[s:s + QUERIES]
            found += self._scan(q, first[of[q]], stop[of[q]], shared[of[q]])
        return tuple(np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in range(2))

    def _scan(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray):
        """Advance runs [low, high) that share ``depth`` letters with a band of
        cells for the query's first depth - 1, depth and depth + 1 letters."""
        band = [np.where(depth > 0, 1, FAR), np.zeros(len(q), np.int64), np.where(self.length[q] > depth, 1, FAR)]
        found = []
        while len(q):
            ended = self.length[low] == depth
            cell = self.length[q] - depth + 1
            hit = ended & (cell >= 0) & (cell <= 2) & (np.choose(np.clip(cell, 0, 2), band) == 1)
            if hit.any():
                found.append((q[hit], low[hit]))
            low = low + ended
            # split each run where its words part at this depth
            a = np.searchsorted(self.marks, depth * (self.n + 1) + low, side="right")
            b = np.searchsorted(self.marks, depth * (self.n + 1) + high, side="left")
            parts = np.where(low < high, b - a + 1, 0)
            row = np.repeat(np.arange(len(q)), parts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            q, depth, high, low, base = q[row], depth[row], high[row], low[row], a[row]
            if not len(q):
                break
            begin = base + place
            size = len(self.marks)
            mark = lambda i: self.marks[np.minimum(i, size - 1)] - depth * (self.n + 1) if size else high
            last = place == parts[row] - 1
            low, high = np.where(place == 0, low, mark(np.maximum(begin - 1, 0))), np.where(last, high, mark(begin))
            letter = self.codes[self.start[low] + depth]
            b0, b1, b2 = (x[row] for x in band)
            length, start = self.length[q], self.start[q]
            cost = [np.where((depth + i >= 0) & (depth + i < length), self.codes[np.clip(start + depth + i, 0, len(self.codes) - 1)] != letter, FAR)
                    for i in (-1, 0, 1)]
            n0 = np.minimum(b0 + cost[0], b1 + 1)
            n1 = np.minimum(np.minimum(b1 + cost[1], b2 + 1), n0 + 1)
            n2 = np.minimum(b2 + cost[2], n1 + 1)
            depth = depth + 1
            n0 = np.where(depth - 1 <= length, n0, FAR)
            n1 = np.where(depth <= length, n1, FAR)
            n2 = np.where(depth + 1 <= length, n2, FAR)
            keep = np.minimum(np.minimum(n0, n1), n2) <= 1
            q, low, high, depth = q[keep], low[keep], high[keep], depth[keep]
            band = [n0[keep], n1[keep], n2[keep]]
        return found


def near_words(counts: DataFrame, min_length: int = 1, group_words: int = 1 << 16) -> DataFrame:
    """(``word``, ``near``, ``near_n``) for all pairs of words of ``counts``
    (distinct ``word`` within U+00FF, ``n``) that differ by exactly one inserted,
    deleted or replaced code point; each pair both ways, once.  ``min_length``:
    code points that every word has at least."""
    size = F.length("word")

    def member(side: str, less: int):
        """The word in the group whose shorter words have ``less`` letters less."""
        ell = size - F.lit(less)
        half = F.floor(ell / 2).cast("int")
        text, share = (F.col("word"), half) if side == "f" else (F.reverse("word"), ell - half)
        key = F.concat(F.lit(side), ell.cast("string"), F.lit(":"), F.substr(text, F.lit(1), share))
        return F.struct(key.alias("key"), F.lit(side).alias("side"), ell.alias("ell"), share.alias("share"), text.alias("text"), "n")

    both = F.array(member("f", 0), member("r", 0))
    groups = F.when(size > min_length, F.concat(both, F.array(member("f", 1), member("r", 1)))).otherwise(both)
    keyed = counts.select("word", "n").select(F.inline(groups))
    hot = materialise(keyed.groupBy("key").count().where(F.col("count") > group_words).select("key"))
    if not hot.isEmpty():
        large = keyed.join(hot, "key", "left_semi")
        keyed = keyed.join(hot, "key", "left_anti").unionByName(large.select(
            F.explode(_by_place(F.col("key"), F.col("text"), F.col("ell"), F.col("share"))).alias("key"), "side", "ell", "share", "text", "n"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sides, ells, texts, counted in _whole_groups(batches, group_words):
            group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
            words = SortedWords([t.encode("latin-1") for t in texts], group)
            a, b = words.near()
            shorter = np.minimum(words.length[a], words.length[b]) == ells[a]
            a, b = a[shorter], b[shorter]
            out: tuple[list, list, list] = ([], [], [])
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = texts[i], texts[j]
                if sides[i] == "r":
                    x, y, half = x[::-1], y[::-1], ells[i] // 2
                    if x[:half] == y[:half]:  # the group by first half has the pair
                        continue
                out[0].append(x)
                out[1].append(y)
                out[2].append(counted[j])
            for s in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(o[s:s + (1 << 16)], t) for o, t in zip(out, (pa.string(), pa.string(), pa.int64()))],
                                                 names=["word", "near", "near_n"])

    return (keyed.select("key", "side", "ell", "text", "n").repartition("key").sortWithinPartitions("key", "text")
            .mapInArrow(tidy(near), "word string, near string, near_n long"))


def _by_place(key, text, ell, share):
    """Keys of a word of a large group: the word without one letter behind the
    shared half, marked with its place for words that differ in a letter."""
    without = lambda i: F.concat(F.substr(text, F.lit(1), i), F.substr(text, i + F.lit(2)))
    place = F.sequence(share, F.length(text) - F.lit(1))
    cut = F.array_distinct(F.transform(place, lambda i: F.concat(key, F.lit("+"), without(i))))
    marked = F.transform(place, lambda i: F.concat(key, F.lit("*"), i.cast("string"), F.lit(":"), without(i)))
    return F.when(F.length(text) > ell, cut).otherwise(F.array_append(marked, F.concat(key, F.lit("+"), text)))


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int):
    """Columns of about ``rows`` rows, cut between keys."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            keys = np.array(table.column(0).to_pylist(), dtype=object)
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(ends):
                yield _columns(table.slice(0, ends[-1]))
                table = table.slice(ends[-1])
            waiting, size = [table], table.num_rows
    if size:
        yield _columns(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])


def _columns(rows: pa.RecordBatch):
    keys, sides, ells, texts, counted = (c.to_pylist() for c in rows.columns)
    return np.array(keys, dtype=object), sides, np.array(ells, dtype=np.int64), texts, counted


def spelling_variants(counts: DataFrame, ratio: int = 10, min_length: int = 1, group_words: int = 1 << 16) -> DataFrame:
    """Per word of ``counts`` (``word``, ``n``): ``word``, ``n``, ``n_near``
    (words one edit apart), ``form`` (of these the one with the largest n if it
    has at least ``ratio`` times the word's n; ties: smallest in code-point
    order; else null), ``form_n``, ``root`` (the last word that forms lead to,
    the word itself if it has none).  No words: no rows."""
    counts = materialise(counts.select("word", "n"))
    best = near_words(counts, min_length, group_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = materialise(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")))

    # forms have ever larger counts, so following pointers doubles its reach each round and ends
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                      F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
