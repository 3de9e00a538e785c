"""WARC archives with a two-level capture index.

Records are written where their rows are. Index lines are sorted by reversed-host URL key
into compressed blocks; a sparse directory holds the first key of each block, and a list
of index parts the first key of each directory. A lookup binary-searches the list, one
directory and one block, then reads the record's byte range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import string
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import stage_folder, write_stage

BLOCK_LINES = 512
READ_BYTES = 8 << 20  # neighbouring ranges are read together up to this size
GAP_BYTES = 64 << 10
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column, page_id: Column) -> Column:
    """``com,example,www)/path?query`` and the id; unique per page, sortable by bytes."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", "")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0),
                       string.ascii_uppercase, string.ascii_lowercase)
    key = F.concat(F.concat_ws(",", F.reverse(F.split(host, "[.]"))), F.lit(")"),
                   F.regexp_replace(rest, "^[^/?#]*", ""))
    return F.concat(F.regexp_replace(key, "[\\x00-\\x20]", "+"), F.lit(" "),
                    F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(key, id, url, body, digest, first): first is the smallest id with the payload.

    Null where the payload is below 100 bytes, found once, or has no id at all. The
    digests are counted on their own; only those found again meet the pages, so a payload
    that fills a third of the rows is one row of the smaller side.
    """
    rows = pages.select(
        url_key(F.col(url_col), F.col(id_col)).alias("key"), F.col(id_col).alias("id"),
        F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    digest = F.sha2(F.col("body"), 256)
    again = write_stage(
        rows.where(F.octet_length("body") >= MIN_REVISIT).groupBy(digest.alias("d"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("d", "first"), "payloads")
    return rows.withColumn("digest", digest).join(again, F.col("digest") == F.col("d"), "left").drop("d")


def record(page: str, url: str | None, body: bytes, digest: str, first: str | None) -> bytes:
    """One gzip member with a response, or a revisit of ``first`` without the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode()
    block = http if first is not None else http + body
    head = [("WARC-Type", "response" if first is None else "revisit"),
            ("WARC-Record-ID", f"<urn:x-page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if first is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"),
             ("Content-Type", "application/http;msgtype=response"),
             ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[str, int, str, str, str | None]:
    """(page, payload bytes, digest, type, refers to); checks the payload of a response."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (
            len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, first = (fields.get(k) and fields[k][len("<urn:x-page:"):-1]
                   for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return page, size, digest, fields["WARC-Type"], first


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task; returns index lines (key, file, offset, length).

    A task that is run again writes a file of another name, and only the lines of the
    attempt that ended are kept, so a lost executor leaves at most an unused file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for b in batches:
            lines = []
            for key, page, url, body, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                data = record(page, url, body.encode(), digest, first)
                out.write(data)
                lines.append((key, name, at, len(data)))
                at += len(data)
            if lines:
                yield _batch(lines, LINE)
        if out is not None:
            out.close()

    other = ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    cols = marked.select("key", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
                         "url", "body", "digest",
                         F.when(other, F.col("first").cast("string")).alias("first"))
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    return write_stage(cols.mapInArrow(run, "key string, file string, offset long, length long"),
                       "lines")


LINE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                  ("length", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Sorts lines by key into blocks; returns the parts (first key, file, offset, length).

    Each task writes one part: compressed blocks, then its directory of (first key,
    offset, length). The list has one row per task, whatever the number of lines. A part
    begins anew at a key, so equal keys never straddle parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        store, root = fs.FileSystem.from_uri(folder)
        name, out, at, directory, block = f"{root}/index-{uuid.uuid4().hex}", None, 0, [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, block)).encode(), 6)
            out.write(data)
            directory.append((block[0][0], at, len(data)))
            at += len(data)
            block.clear()

        for row in rows:
            out = out or store.open_output_stream(name, compression=None)
            block.append(row)
            if len(block) == block_lines:
                flush()
        if out is None:
            return
        if block:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data)
        out.close()
        yield _batch([(directory[0][0], name, at, len(data))], LINE)

    parts = write_stage(lines.repartitionByRange("key").sortWithinPartitions("key")
                        .mapInArrow(run, "key string, file string, offset long, length long"),
                        "parts")
    return sorted((r.key.encode(), r.file, r.offset, r.length) for r in parts.collect())


class _Index:
    """The searching side of one task; keeps one directory and one block at a time."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.store = fs.FileSystem.from_uri(folder)[0]
        self.parts, self.firsts = parts, [p[0] for p in parts]
        self.kept: dict[str, tuple] = {}

    def _read(self, kind: str, file: str, offset: int, length: int):
        if self.kept.get(kind, (None,))[0] != (file, offset):
            with self.store.open_input_file(file) as f:
                data = zlib.decompress(f.read_at(length, offset)).decode()
            value = (json.loads(data) if kind == "directory"
                     else [json.loads(x) for x in data.split("\n")])
            self.kept[kind] = ((file, offset), value, [x[0].encode() for x in value])
        return self.kept[kind][1:]

    def find(self, key: bytes) -> Iterator[tuple]:
        """Lines of the key; several blocks may hold it."""
        part = bisect_left(self.firsts, key)
        for p in self.parts[max(0, part - 1):]:
            if p[0] > key:
                break
            directory, firsts = self._read("directory", *p[1:])
            k = max(0, bisect_left(firsts, key) - 1)
            while k < len(directory) and firsts[k] <= key:
                lines, keys = self._read("block", p[1], *directory[k][1:])
                i = bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    yield tuple(lines[i])
                    i += 1
                k += 1


def lookup(keys: DataFrame, folder: str, parts: list[tuple]) -> DataFrame:
    """Index lines of the keys (column ``key``); sorted keys make block reads consecutive."""
    sent = keys.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(folder, sent.value)
        for b in batches:
            rows = [x for k in b.column(0).to_pylist() for x in index.find(k.encode())]
            if rows:
                yield _batch(rows, LINE)

    return (keys.select("key").where("key IS NOT NULL").distinct()
            .repartitionByRange("key").sortWithinPartitions("key")
            .mapInArrow(run, "key string, file string, offset long, length long"))


def _ranges(rows: list[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """(file, from, to, members): neighbouring byte ranges read together."""
    file, a, b, own = "", 0, 0, []
    for f, offset, length in rows:
        if own and (f != file or not b <= offset <= b + GAP_BYTES or offset + length - a > READ_BYTES):
            yield file, a, b, own
            own = []
        if not own:
            file, a = f, offset
        own.append((offset - a, length))
        b = offset + length
    if own:
        yield file, a, b, own


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) of index lines.

    The lines, not the payloads, are dealt by file and offset, so that each task reads
    its archives forwards.
    """
    kind = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("record_type", pa.string()),
                      ("refers", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, file, f = fs.FileSystem.from_uri(folder)[0], "", None
        for batch in batches:
            for name, a, b, own in _ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if name != file:
                    f = f.close() if f else None
                    file, f = name, store.open_input_file(name)
                data = f.read_at(b - a, a)
                yield _batch([parse(data[x:x + n]) for x, n in own], kind)
        if f:
            f.close()

    return (found.select("file", "offset", "length").repartitionByRange("file", "offset")
            .sortWithinPartitions("file", "offset")
            .mapInArrow(run, "page string, payload_bytes long, payload_digest string, "
                             "record_type string, refers string"))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes archives and index, then finds each page by key and reads its record.

    One row per row of ``pages``. Null payloads are empty, null urls have an empty host
    in the key. Repeated rows with the smallest id are all responses; rows without an id
    are revisits where another row with the payload has one. An empty table writes
    nothing and gives no rows.
    """
    folder = folder or stage_folder(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    lines = write_archives(mark_revisits(pages, id_col, url_col, html_col), folder)
    parts = write_index(lines, folder)
    keys = pages.select(url_key(F.col(url_col), F.col(id_col)).alias("key"))
    got = read_records(lookup(keys, folder, parts), folder)
    return got.select(F.when(F.col("page") != "", F.col("page")).cast(kind).alias(id_col),
                      "payload_bytes", "payload_digest", "record_type",
                      F.col("refers").cast(kind).alias("refers_to"))
