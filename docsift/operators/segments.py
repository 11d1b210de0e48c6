"""A text index kept current, in segments.

A run writes its new and changed documents as one segment: their rows, postings
in (token, id) order with positions, document counts per token and, if wanted,
3-grams.  Segments are never changed.  Documents that a run replaces or deletes
become tombstones of the segments that hold them, with the token counts to take
off again.  A manifest per version names the live segments with their totals, so
the number of documents, the mean length and document frequencies are merged from
stored numbers, and every query answers as on an index built anew.

Segments of like size are merged once there are ``FAN`` of them, and one that is
mostly tombstones is written again, so a posting is rewritten about log(size)
times in all: what a run writes follows what it changes.  Data is written first
and its manifest last; what a failed run leaves behind is never read.

    postings/segment=S   token, id, field, tf, dl, mask, first, weighted, pos
    blocks/segment=S     token, mean, lists of block, most, n
    terms/segment=S      token, mask, n
    docs/segment=S       the document rows, in id order
    grams/segment=S      gram, id, field
    gone/version=V       segment, id: what the version replaces or deletes
    dead/version=V       segment, id, dl
    dead_terms/version=V segment, token, mask, n
    manifest/version=V   segment, n_docs, total, n_postings, dead_docs, dead_total, written

``mask`` has a bit for every field of the document that holds the token, and
``first`` marks the posting of the lowest one, so a document is counted once for
any choice of fields.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import standard_tokens
from docsift.operators.fulltext import BM25_B, BM25_K1, FIELD_WEIGHTS, FUZZY_BOOSTS, TextIndex, write_in_order
from docsift.operators.runs import write_document_grams, write_document_postings, write_stored_grams
from docsift.session import short_rows

FAN = 4  # segments of like size that are merged into one
FIELDS = tuple(FIELD_WEIGHTS)
POSTINGS = "token string, id long, field string, tf long, dl long, mask int, first boolean, weighted double, pos array<int>"
BLOCK = 64  # ids of a block, for which the index keeps bounds of the scores
HELD_IDS = 1 << 20  # ids of replaced documents that every executor may hold
SHORT = 1024  # bytes of a token that is not a long one


def _held(ids: DataFrame, n: int) -> DataFrame:
    """``n`` ids to be joined: held by every executor if they are few, so what
    they are joined to stays where it is, whatever the session's own bound."""
    return F.broadcast(ids) if n <= HELD_IDS else ids


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, three shares to each so that none waits long for
    another, where the input has fewer splits than that; larger inputs stay as
    they are."""
    shares = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(shares) if df.rdd.getNumPartitions() < shares else df


def score_blocks(postings: DataFrame, mean: float) -> DataFrame:
    """(token, mean, block, most, n) of postings in (token, id) order: the last
    three are lists with an entry for each block of the token.  Each run of rows
    is counted where it is read, without a shuffle; a token or block that a run
    cuts has a row or an entry for each part."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).dictionary_encode()
            code, block = words.indices.to_numpy(), batch.column(1).to_numpy() // BLOCK
            begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
            f = batch.column(2).to_numpy()
            ratio = f / (f + BM25_K1 * (1 - BM25_B) + BM25_K1 * BM25_B / mean * batch.column(3).to_numpy())
            of = code[begin]
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            ends = pa.array(np.append(start, len(of)).astype(np.int32))
            lists = [block[begin], np.maximum.reduceat(ratio, begin), np.diff(np.append(begin, len(code)))]
            yield pa.RecordBatch.from_arrays([
                words.dictionary.take(pa.array(of[start])), pa.array(np.full(len(start), mean)),
                *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]], names=["token", "mean", "block", "most", "n"])

    return postings.where("first").select("token", "id", "weighted", "dl").mapInArrow(
        count, "token string, mean double, block array<long>, most array<double>, n array<long>")


def document_postings(docs: DataFrame, fields=FIELDS, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of documents, each counted in its own row without a shuffle
    (``POSTINGS``, and the string columns ``keep`` of the row).  ``weighted``, on
    the first posting of a token in a document, is its count over all fields by
    the weights of the ranking."""
    weights = np.array([FIELD_WEIGHTS.get(f, 1.0) for f in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *keep, *[standard_tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    n_keep, names = len(keep), pa.array(list(fields), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256)):
            row, field, place, tokens = [], [], [], []
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for f in range(len(fields)):
                column = batch.column(1 + n_keep + f)
                size = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
                total += size
                row.append(np.repeat(np.arange(batch.num_rows), size))
                field.append(np.full(len(row[-1]), f))
                place.append(np.arange(len(row[-1])) - np.repeat(np.cumsum(size) - size, size))
                tokens.append(column.flatten())
            words = pa.chunked_array(tokens).combine_chunks().dictionary_encode()
            if not len(words):
                continue
            row, field, place, code = (*map(np.concatenate, (row, field, place)), words.indices.to_numpy())
            # by (document, token); within it the rows stand by field and place already
            order = np.argsort(row * len(words.dictionary) + code, kind="stable")
            row, field, place, code = row[order], field[order], place[order], code[order]
            word = np.ones(len(row), dtype=bool)  # begins a (document, token)
            word[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            post = word.copy()
            post[1:] |= field[1:] != field[:-1]
            start = np.flatnonzero(post)
            ends = np.append(start, len(row)).astype(np.int32)
            first = word[start]
            begin = np.flatnonzero(first)
            mask = np.repeat(np.bitwise_or.reduceat(1 << field[start], begin), np.diff(np.append(begin, len(start))))
            weighted = np.zeros(len(start))
            weighted[begin] = np.add.reduceat(np.diff(ends) * weights[field[start]], begin)
            row, at = row[start], pa.array(row[start])
            yield pa.RecordBatch.from_arrays([
                words.dictionary.take(pa.array(code[start])), batch.column(0).take(at), names.take(pa.array(field[start])),
                pa.array(np.diff(ends).astype(np.int64)), pa.array(total[row]), pa.array(mask.astype(np.int32)), pa.array(first),
                pa.array(weighted, mask=~first), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))),
                *[batch.column(1 + i).take(at) for i in range(n_keep)]],
                names=["token", "id", "field", "tf", "dl", "mask", "first", "weighted", "pos", *keep])

    return rows.mapInArrow(count, POSTINGS + "".join(f", {c} string" for c in keep))


def token_counts(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(segment, token, mask, n) of documents (``segment``, ``id``): how many of a
    segment have the token in those fields.  Counted a run of documents at a time
    first, so that rows for each document and token are never made."""
    rows = docs.select("segment", *[standard_tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    n_fields = len(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            row, field, tokens = [], [], []
            for f in range(n_fields):
                column = batch.column(1 + f)
                size = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
                row.append(np.repeat(np.arange(batch.num_rows), size))
                field.append(np.full(len(row[-1]), f))
                tokens.append(column.flatten())
            words, names = pa.chunked_array(tokens).combine_chunks().dictionary_encode(), batch.column(0).dictionary_encode()
            if not len(words):
                continue
            row, field, n_words = np.concatenate(row), np.concatenate(field), len(words.dictionary)
            found = np.unique((row * n_words + words.indices.to_numpy()) * n_fields + field)
            pair = found // n_fields
            begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            mask, pair = np.bitwise_or.reduceat(1 << found % n_fields, begin), pair[begin]
            of = names.indices.to_numpy()[pair // n_words].astype(np.int64)
            key, n = np.unique((of * n_words + pair % n_words << n_fields) + mask, return_counts=True)
            mask, word = key & (1 << n_fields) - 1, key >> n_fields
            yield pa.RecordBatch.from_arrays([
                names.dictionary.take(pa.array(word // n_words)), words.dictionary.take(pa.array(word % n_words)), pa.array(mask.astype(np.int32)), pa.array(n)],
                names=["segment", "token", "mask", "n"])

    found = rows.mapInArrow(count, "segment string, token string, mask int, n long")
    return found.groupBy("segment", "token", "mask").agg(F.sum("n").alias("n"))


def document_length(fields=FIELDS):
    """Tokens of all fields of a document."""
    sizes = [F.when(F.col(f).isNull(), 0).otherwise(F.size(standard_tokens(F.col(f)))) for f in fields]
    return functools.reduce(lambda a, b: a + b, sizes).cast("long")


@dataclass(frozen=True)
class Segment:
    """A line of the manifest; ``written``: postings that its version wrote for it."""
    segment: str
    n_docs: int
    total: int
    n_postings: int
    dead_docs: int = 0
    dead_total: int = 0
    written: int = 0


MANIFEST = "segment string, n_docs long, total long, n_postings long, dead_docs long, dead_total long, written long"


class SegmentedIndex(TextIndex):
    """The live state of an index at its last version."""

    def __init__(self, spark: SparkSession, path: str, version: int, segments: list[Segment], fields=FIELDS, grams: bool = False,
                 partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.version, self.segments = spark, path, version, segments
        self.fields, self.has_grams, self.partition_by = tuple(fields), grams, partition_by
        n_docs = sum(s.n_docs - s.dead_docs for s in segments)
        total = sum(s.total - s.dead_total for s in segments)
        stats = spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(total / n_docs if n_docs else 0.0).alias("avgdl"))
        super().__init__(self.live("postings"), stats, grams=self.live("grams") if grams else None)

    # -------------------------------------------------------------- reading

    def _stored(self, kind: str, names: list[str]) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{kind}")
        return df.where(F.col("segment").isin(names) if names else F.lit(False))

    def _dead(self, kind: str, names: list[str]) -> DataFrame | None:
        """Tombstones of some segments; None if there are none."""
        if not any(s.dead_docs for s in self.segments if s.segment in names):
            return None
        return self.spark.read.parquet(f"{self.path}/{kind}").where(F.col("segment").isin(names))

    def live(self, kind: str, names: list[str] | None = None) -> DataFrame:
        """Rows of the live documents (of some segments), with their ``segment``."""
        names = [s.segment for s in self.segments] if names is None else names
        rows, dead = self._stored(kind, names), self._dead("dead", names)
        if dead is None:
            return rows
        whole = [s.segment for s in self.segments if s.segment in names and not s.dead_docs]
        ids = _held(dead.select("segment", "id"), self._n_dead(names))
        left = self._stored(kind, [n for n in names if n not in whole]).join(ids, ["segment", "id"], "left_anti")
        return left.unionByName(self._stored(kind, whole)) if whole else left

    def _n_dead(self, names: list[str]) -> int:
        return sum(s.dead_docs for s in self.segments if s.segment in names)

    @property
    def documents(self) -> DataFrame:
        return self.live("docs").drop("segment")

    def terms(self, tokens: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
        """(token, mask, n): documents of each token by the fields that hold it."""
        names = [s.segment for s in self.segments] if names is None else names
        rows, dead = self._stored("terms", names).select("token", "mask", "n"), self._dead("dead_terms", names)
        if dead is not None:
            rows = rows.unionByName(dead.select("token", "mask", (-F.col("n")).alias("n")))
        if tokens is not None:
            rows = rows.where(F.col("token").isin(tokens))
        return rows.groupBy("token", "mask").agg(F.sum("n").alias("n")).where(F.col("n") > 0)

    def document_frequency(self, tokens: list[str], fields: list[str] | None = None) -> DataFrame:
        """(token, n) from the stored counts, for any choice of fields."""
        wanted = sum(1 << i for i, f in enumerate(self.fields) if fields is None or f in fields)
        return (self.terms(tokens).where(F.col("mask").bitwiseAND(F.lit(wanted)) != 0)
                .groupBy("token").agg(F.sum("n").alias("n")))

    def blocks(self, tokens: list[str]) -> DataFrame:
        """(token, block, most, n): of the documents with a token among ``BLOCK``
        ids their number and a bound of f / (f + k1 (1 - b + b dl / avgdl)), the
        part of a score that depends on the document (tombstones included, all
        fields: bounds stay bounds).  The largest one is stored for the mean
        length of its segment; for a mean that is m times as long it is at most
        m times as large."""
        segments = self.segments
        avgdl = sum(s.total - s.dead_total for s in segments) / max(1, sum(s.n_docs - s.dead_docs for s in segments))
        rows = self._stored("blocks", [s.segment for s in segments]).where(F.col("token").isin(tokens))
        rows = rows.select("token", "mean", F.inline(F.arrays_zip("block", "most", "n")))
        most = F.col("most") * F.greatest(F.lit(1.0), F.lit(float(avgdl)) / F.col("mean"))
        return rows.groupBy("token", "block").agg(F.max(most).alias("most"), F.sum("n").alias("n"))

    # -------------------------------------------------------------- writing

    def _write_texts(self, name: str, names: list[str]) -> None:
        """Postings and 3-grams that other segments hold.  Reading these rows twice
        costs less than a copy of them, unless their tombstones are too many to
        be held."""
        n, keep = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self._n_dead(names) > HELD_IDS
        columns = ["token", "id", "field", "tf", "dl", "mask", "first", "weighted", "pos"]
        write_in_order(self.live("postings", names).select(*columns), f"{self.path}/postings/segment={name}", ["token", "id"], n, also=("field",), keep=keep)
        self._write_blocks(name)
        if self.has_grams:
            n_docs = sum(s.n_docs - s.dead_docs for s in self.segments if s.segment in names)
            write_stored_grams(self.live("grams", names), f"{self.path}/grams/segment={name}", tuple(FUZZY_BOOSTS), n, n_docs)

    def _write_blocks(self, name: str) -> None:
        written, out = self.spark.read.parquet(f"{self.path}/postings/segment={name}"), f"{self.path}/blocks/segment={name}"
        n_docs = self.spark.read.parquet(f"{self.path}/docs/segment={name}").count()
        total, longest = written.agg(F.sum("tf"), F.max(F.octet_length("token"))).first()
        mean = max(1.0, (total or 0) / max(n_docs, 1))
        short = F.octet_length("token") <= SHORT
        with short_rows(self.spark, SHORT + 64):  # a token and three numbers
            score_blocks(written.where(short), mean).write.mode("overwrite").parquet(out)
        if (longest or 0) > SHORT:
            score_blocks(written.where(~short), mean).write.mode("append").parquet(out)

    def _write_terms(self, name: str, terms: DataFrame) -> None:
        (terms.repartitionByRange("token").sortWithinPartitions("token")
         .write.mode("overwrite").parquet(f"{self.path}/terms/segment={name}"))

    def _write_docs(self, name: str, docs: DataFrame) -> DataFrame:
        by = [*self.partition_by, "id"]
        writer = docs.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
        out = f"{self.path}/docs/segment={name}"
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(out)
        return self.spark.read.schema(docs.schema).parquet(out)

    def _line(self, name: str) -> Segment:
        """Totals of a written segment."""
        n_docs = self.spark.read.parquet(f"{self.path}/docs/segment={name}").count()
        total, n = self.spark.read.parquet(f"{self.path}/postings/segment={name}").agg(
            F.coalesce(F.sum("tf"), F.lit(0)), F.count(F.lit(1))).first()
        return Segment(name, n_docs, int(total), n, written=n)

    def _write_segment(self, name: str, docs: DataFrame) -> Segment:
        stored = self._write_docs(name, docs)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write_document_postings(stored.select("id", *self.fields), f"{self.path}/postings/segment={name}", self.fields, "id", POSTINGS, FIELD_WEIGHTS, n)
        self._write_blocks(name)
        if self.has_grams:
            grams = [f for f in FUZZY_BOOSTS if f in docs.columns]
            write_document_grams(stored.select("id", *grams), f"{self.path}/grams/segment={name}", grams, "id", n)
        written = self.spark.read.parquet(f"{self.path}/postings/segment={name}")
        self._write_terms(name, written.where("first").groupBy("token", "mask").agg(F.count(F.lit(1)).alias("n")))
        return self._line(name)

    def _commit(self, segments: list[Segment]) -> SegmentedIndex:
        version = self.version + 1
        rows = [tuple(vars(s).values()) for s in segments]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}"))
        return SegmentedIndex(self.spark, self.path, version, segments, self.fields, self.has_grams, self.partition_by)

    def upsert(self, docs: DataFrame | None = None, deletes: DataFrame | None = None, merge: bool = True) -> SegmentedIndex:
        """Documents of ``docs`` replace those with their id or are added,
        those with an id in ``deletes`` go; returns the next version.  An id in
        both is replaced."""
        version = self.version + 1
        ids = [d.select(F.col("id").cast("long").alias("id")) for d in (docs, deletes) if d is not None]
        added = [] if docs is None else [self._write_segment(f"s{version:06d}", docs)]
        before = self.segments
        if ids and before:
            changed = functools.reduce(lambda a, b: a.unionByName(b), ids).distinct()
            place = f"version={version}"
            # found by ids alone and written, so their number is known when their texts are read, once
            self.live("docs").select("segment", "id").join(changed, "id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/gone/{place}")
            ids = self.spark.read.schema("segment string, id long").parquet(f"{self.path}/gone/{place}")
            gone = (self._stored("docs", [s.segment for s in before]).select("segment", "id", *self.fields)
                    .join(_held(ids, ids.count()), ["segment", "id"], "left_semi").persist(StorageLevel.DISK_ONLY))
            gone.select("segment", "id", document_length(self.fields).alias("dl")).write.mode("overwrite").parquet(f"{self.path}/dead/{place}")
            token_counts(gone, self.fields).write.mode("overwrite").parquet(f"{self.path}/dead_terms/{place}")
            gone.unpersist()
            lost = {r.segment: r for r in self.spark.read.parquet(f"{self.path}/dead/{place}").groupBy("segment").agg(
                F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()}  # a row a segment at most
            before = [replace(s, dead_docs=s.dead_docs + lost[s.segment].n, dead_total=s.dead_total + lost[s.segment].dl, written=0)
                      if s.segment in lost else replace(s, written=0) for s in before]
        after = self._commit([*(replace(s, written=0) for s in before), *added])
        return after.merged() if merge else after

    def _due(self) -> list[Segment]:
        """Segments to merge next: mostly dead ones, or ``FAN`` of one size."""
        dead = [s for s in self.segments if s.dead_docs and 2 * s.dead_docs > s.n_docs]
        if dead:
            return dead
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            tiers.setdefault(int(math.log(max(s.n_postings, 1), FAN)), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), [])

    def merged(self) -> SegmentedIndex:
        """The index after all merges that are due."""
        index = self
        while due := index._due():
            index = index._merge(due)
        return index

    def compact(self) -> SegmentedIndex:
        """Everything live in one segment."""
        return self if len(self.segments) == 1 and not self.segments[0].dead_docs else self._merge(self.segments)

    def _merge(self, due: list[Segment]) -> SegmentedIndex:
        names, name = [s.segment for s in due], f"m{self.version + 1:06d}"
        rest = [replace(s, written=0) for s in self.segments if s.segment not in names]
        if all(s.dead_docs >= s.n_docs for s in due):
            return self._commit(rest)
        self._write_docs(name, self.live("docs", names).drop("segment"))
        self._write_texts(name, names)
        self._write_terms(name, self.terms(names=names))
        return self._commit([*rest, self._line(name)])


def create_index(docs: DataFrame, path: str, fields=FIELDS, grams: bool = False, partition_by: tuple[str, ...] = ()) -> SegmentedIndex:
    """A new index of ``docs`` (``id`` and the text fields, other columns are
    kept with the documents) under ``path``."""
    spark = docs.sparkSession
    first = SegmentedIndex.__new__(SegmentedIndex)
    first.spark, first.path, first.version, first.segments = spark, path, 0, []
    first.fields, first.has_grams, first.partition_by = tuple(fields), grams, partition_by
    settings = [(list(fields), grams, list(partition_by))]
    spark.createDataFrame(settings, "fields array<string>, grams boolean, partition_by array<string>").write.mode("overwrite").parquet(f"{path}/settings")
    return first._commit([first._write_segment("s000001", docs)])


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SegmentedIndex:
    """The index at its last version, or at an earlier one."""
    lines = spark.read.parquet(f"{path}/manifest")
    if version is None:
        version = lines.agg(F.max("version")).first()[0]
    rows = lines.where(F.col("version") == version).drop("version").collect()  # a row a segment
    settings = spark.read.parquet(f"{path}/settings").first()
    return SegmentedIndex(spark, path, version, [Segment(**r.asDict()) for r in rows], settings.fields, settings.grams, tuple(settings.partition_by))


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """(version, n_segments, n_docs, n_postings, written): what every version
    holds and how many postings it wrote."""
    return spark.read.parquet(f"{path}/manifest").groupBy(F.col("version").cast("long").alias("version")).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("n_docs") - F.col("dead_docs")).alias("n_docs"),
        F.sum("n_postings").alias("n_postings"), F.sum("written").alias("written"))
