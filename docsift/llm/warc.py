"""WARC archives with a two-level capture index.

Writing: pages are range-partitioned on (reversed-host URL key, page id), each
becomes one gzip member, and each task writes one archive and one index
file to the shared folder.  An index file holds the sorted capture lines in
compressed blocks, then a sparse directory with the first capture of every
block, then a fixed footer that says where the directory is.  The files of a
task get fresh names, and only those that a finished task has reported are part
of the archive, so a retried or speculative task does no harm.

Reading: requests are range-partitioned on the same key.  A task finds the part
(one entry per index file), reads its directory, binary-searches the directory
for the block and the block for the capture, and range-reads the record.

Equal payloads of at least ``revisit_bytes`` are stored once, under the largest
page id; the other pages become revisit records that name it.
"""

from __future__ import annotations

import base64
import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import chunked, materialise, only, tidy

# Fixed values of the format.
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FOOTER = struct.Struct("<QQ8s")
MAGIC = b"CAPTIDX1"

BLOCK_LINES = 1024
BLOCK_BYTES = 8 << 20
# A digest's rows are spread over so many partitions of the join that marks revisits.
SALTS = 16

SCHEMA = ("page_id long, url string, record_type string, refers_to long, refers_to_url string, payload binary, "
          "archive string, offset long, length long")


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query;
    lower-cased host, no scheme, no fragment, control characters and blanks
    escaped.  A null URL has the empty key."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    rest = F.regexp_replace(clean, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?:]*)", 1))
    tail = F.regexp_replace(rest, "^[^/?:]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), tail)
    return F.when(clean == "", F.lit("")).otherwise(F.regexp_replace(key, "[\\x00-\\x20\\x7f]", "_"))


def _line(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(kind: str, page_id, url, digest: str) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE),
           ("Content-Type", "application/http; msgtype=response"),
           ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        out.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        out.append(("X-Page-Id", str(page_id)))
    return out


def response_member(page_id, url, digest: str, payload: bytes) -> bytes:
    return _member(_headers("response", page_id, url, digest), HTTP_HEAD % len(payload) + payload)


def revisit_member(page_id, url, digest: str, origin_id: int, origin_url) -> bytes:
    more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(origin_id, digest)),
            ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(origin_id))]
    if origin_url is not None:
        more.append(("WARC-Refers-To-Target-URI", _line(origin_url)))
    return _member(_headers("revisit", page_id, url, digest) + more, b"HTTP/1.1 200 OK\r\n\r\n")


def parse_member(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    return headers, rest[:int(headers["Content-Length"])]


def _files(uri: str):
    """(file system, path) of a URI of any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Archive:
    """A written archive: its folder and the parts, in key order, as
    (first key, first page id, last key, last page id, index file, archive file)."""
    spark: SparkSession
    path: str
    parts: list[tuple]


def _order(page_id) -> tuple:
    return (0, 0) if page_id is None else (1, page_id)


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = 1000, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> Archive:
    """Write one record per row of ``pages`` below ``path`` (a shared folder).

    A null html is an empty payload, a null URL has no target and the empty
    key.  A null page id is smaller than any other: it revisits an equal
    payload with an id, and is a response otherwise.  Repeated rows are
    written each; several rows with the largest id are responses alike.  An
    empty table gives an archive without parts.  Other columns are not read."""
    rows = only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long"), "url", F.sha1(html).alias("digest"),
                       F.octet_length(html).cast("long").alias("size"), html.alias("html"))
    large = rows.drop("html").where(F.col("size") >= revisit_bytes)
    origin = large.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("origin"), F.count(F.lit(1)).alias("n"))
    origin = origin.where((F.col("n") > 1) & F.col("origin.page_id").isNotNull()).select(
        "digest", "size", F.col("origin.page_id").alias("origin_id"), F.col("origin.url").alias("origin_url"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # marks: which pages revisit which origin, joined on digests alone; payloads
    # travel once, to their range, where a mark stands before its page
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    marks = salted.join(origin, ["digest", "size", "salt"]).where(~F.col("origin_id").eqNullSafe(F.col("page_id")))
    marks = marks.select("key", "page_id", "digest", "origin_id", "origin_url").distinct()
    both = rows.drop("size").withColumn("is_page", F.lit(True)).unionByName(
        marks.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    order = ["key", "page_id", "is_page", "digest"]
    ranged = both.select(*order, "url", "html", "origin_id", "origin_url").repartitionByRange("key", "page_id")
    ranged = ranged.sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_part(path, batches)

    schema = "first string, first_id long, last string, last_id long, index string, archive string, captures long"
    parts = ranged.mapInArrow(tidy(write), schema)
    # one row per written file; the listing decides which files count
    listing = materialise(parts).collect()
    listing.sort(key=lambda r: (r["first"].encode(), _order(r.first_id)))
    return Archive(pages.sparkSession, path, [tuple(r) for r in listing])


def _write_part(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive and its index file from rows in key order."""
    name, store, archive, at = f"part-{uuid.uuid4().hex}", None, None, 0
    lines, blocks, directory = [], [], []
    first = last = None
    captures = 0

    def close_block():
        data = zlib.compress(b"\n".join(line for _, line in lines), 6)
        directory.append([*lines[0][0], sum(map(len, blocks)), len(data)])
        blocks.append(data)
        lines.clear()

    marks, marked = {}, None
    for batch in (x for b in batches for x in chunked([b], BLOCK_BYTES, "html")):
        for key, page_id, is_page, digest, url, html, origin_id, origin_url in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_page:
                if marked != (key, page_id):
                    marks, marked = {}, (key, page_id)
                marks[digest] = (origin_id, origin_url)
                continue
            if store is None:
                store, folder = _files(path)
                store.create_dir(folder, recursive=True)
                archive = store.open_output_stream(f"{folder}/{name}.warc.gz", compression=None)
            origin = marks.get(digest) if marked == (key, page_id) else None
            if origin:
                kind, member = "revisit", revisit_member(page_id, url, digest, *origin)
            else:
                kind, member = "response", response_member(page_id, url, digest, html)
            archive.write(member)
            lines.append(((key, page_id), f"{key}\t{'' if page_id is None else page_id}\t{kind}\t{at}\t{len(member)}".encode()))
            at += len(member)
            first, last, captures = first or (key, page_id), (key, page_id), captures + 1
            if len(lines) == BLOCK_LINES:
                close_block()
    if store is None:
        return
    if lines:
        close_block()
    archive.close()
    with store.open_output_stream(f"{folder}/{name}.idx", compression=None) as f:
        for data in blocks:
            f.write(data)
        sparse = zlib.compress(json.dumps(directory).encode(), 6)
        f.write(sparse)
        f.write(FOOTER.pack(sum(map(len, blocks)), len(sparse), MAGIC))
    row = [*first, *last, f"{path}/{name}.idx", f"{path}/{name}.warc.gz", captures]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                     names=["first", "first_id", "last", "last_id", "index", "archive", "captures"])


class _Index:
    """Look-ups in the parts of an archive; keeps one part and one block."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts
        self.starts = [(p[0].encode(), _order(p[1])) for p in parts]
        self.part = self.block = None
        self.files = {}

    def _open(self, uri: str):
        if uri not in self.files:
            if len(self.files) > 8:
                self.files.pop(next(iter(self.files))).close()
            store, path = _files(uri)
            self.files[uri] = store.open_input_file(path)
        return self.files[uri]

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self._open(uri)
        f.seek(offset)
        return f.read(length)

    def _directory(self, part: int) -> list:
        if self.part != part:
            uri = self.parts[part][4]
            size = self._open(uri).size()
            at, length, magic = FOOTER.unpack(self.read(uri, size - FOOTER.size, FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"not a capture index: {uri}")
            self.sparse = json.loads(zlib.decompress(self.read(uri, at, length)))
            self.block_starts = [(e[0].encode(), _order(e[1])) for e in self.sparse]
            self.part, self.block = part, None
        return self.sparse

    def _lines(self, part: int, block: int) -> list:
        entry = self._directory(part)[block]
        if self.block != block:
            raw = zlib.decompress(self.read(self.parts[part][4], entry[2], entry[3]))
            self.captures = []
            for line in raw.split(b"\n"):
                key, page_id, kind, offset, length = line.split(b"\t")
                self.captures.append((key, _order(int(page_id) if page_id else None), kind, int(offset), int(length)))
            self.block = block
        return self.captures

    def find(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """Captures with low <= (key, id) <= high as (archive, offset, length)."""
        part = max(bisect.bisect_left(self.starts, low) - 1, 0)
        while part < len(self.parts) and self.starts[part] <= high:
            self._directory(part)
            block = max(bisect.bisect_left(self.block_starts, low) - 1, 0)
            while block < len(self.sparse) and self.block_starts[block] <= high:
                lines = self._lines(part, block)
                i = bisect.bisect_left(lines, low)
                while i < len(lines) and lines[i][:2] <= high:
                    yield self.parts[part][5], lines[i][3], lines[i][4]
                    i += 1
                block += 1
            part += 1


def read_captures(archive: Archive, requests: DataFrame, url_col: str = "url", id_col: str | None = "page_id") -> DataFrame:
    """Records of the requested captures: with ``id_col`` those of that URL
    and page id (null meets null), without it all captures of the URL.

    Repeated requests count once; a request without a capture gives no row.
    ``payload`` is null for revisit records, whose ``refers_to`` and
    ``refers_to_url`` request the response."""
    page_id = F.lit(None).cast("long") if id_col is None else F.col(f"`{id_col}`").cast("long")
    wanted = requests.select(url_key(F.col(f"`{url_col}`")).alias("key"), page_id.alias("page_id")).distinct()
    parts, whole_url = archive.parts, id_col is None
    wanted = wanted.repartitionByRange(max(len(parts), 1), "key", "page_id").sortWithinPartitions("key", "page_id")
    if not parts:
        return archive.spark.createDataFrame([], SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows, held = _Index(parts), [], 0
        for batch in batches:
            for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = key.encode()
                low = (key, (0, 0) if whole_url else _order(number))
                high = (key, (2, 0) if whole_url else _order(number))
                for uri, offset, length in index.find(low, high):
                    rows.append((*_record(index.read(uri, offset, length)), uri, offset, length))
                    held += len(rows[-1][5] or b"") + 200
                    if held > BLOCK_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
        if rows:
            yield _rows(rows)

    return wanted.mapInArrow(tidy(read), SCHEMA)


def _record(member: bytes) -> tuple:
    headers, block = parse_member(member)
    page_id, origin = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    kind = headers["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    return (None if page_id is None else int(page_id), headers.get("WARC-Target-URI"), kind,
            None if origin is None else int(origin), headers.get("WARC-Refers-To-Target-URI"), payload)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def payload_digests(archive: Archive, requests: DataFrame) -> DataFrame:
    """Per requested capture: ``page_id``, ``payload_bytes``,
    ``payload_digest`` (lower-case hex SHA-1), ``record_type``, ``refers_to``.
    Digests are taken of the payloads that the archive holds; a revisit record
    gets that of the response it names, each such response being read once."""
    size, digest = F.octet_length("payload").cast("long"), F.sha1("payload")
    got = materialise(read_captures(archive, requests).select(
        "page_id", "url", "record_type", "refers_to", "refers_to_url", size.alias("payload_bytes"), digest.alias("payload_digest")))
    revisits = got.where(F.col("record_type") == "revisit").drop("payload_bytes", "payload_digest")
    names = revisits.select("refers_to", "refers_to_url").distinct()
    origins = read_captures(archive, names, "refers_to_url", "refers_to").where(F.col("record_type") == "response")
    origins = origins.select(F.col("page_id").alias("refers_to"), url_key(F.col("url")).alias("key"), size.alias("payload_bytes"),
                             digest.alias("payload_digest")).distinct()
    # rows of one response are spread over SALTS partitions
    origins = origins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisits = revisits.withColumn("key", url_key(F.col("refers_to_url")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    resolved = revisits.join(origins, ["refers_to", "key", "salt"])
    return got.where(F.col("record_type") == "response").select(*out).unionByName(resolved.select(*out))
