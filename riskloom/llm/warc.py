"""WARC archives with a two-level capture index.

Every page becomes a record, gzipped on its own; of equal payloads the largest page id is a response and the others are revisits that refer to it. Each
task writes one archive and returns an index entry per record.

The index is sorted by reversed-host URL key (then by page id) over range partitions. A partition's entries are written as compressed blocks of
``BLOCK`` lines, followed by the file's sparse directory (the first key of each block) and a footer that tells where that is. The upper level is one row per
index file. A lookup searches the upper level for the files that can hold a key, then a file's directory by bisection, then reads
only the blocks in question, and at last ranges of the archives.

The upper level has as many rows as range partitions; it is the only thing sent to all tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import FILTER_ROWS, hash_filter, materialise, passing, shared_folder
from riskloom.llm.storage import RangeReader, make_folder, new_file

BLOCK = 512
RUNS = 64
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Neighbouring ranges are read at once up to so many bytes.
READ_BYTES = 4 << 20
#: Archive bytes that one task reads back: at most so many, and as few as a megabyte where there are tasks enough.
TASK_BYTES = 128 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host, ")" and the path and query; the fragment, the port and a leading www. go."""
    url = F.coalesce(url, F.lit(""))
    site = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, site + r"([^/?#:]*)", 1)), r"^www\.", "")
    rest = F.regexp_extract(url, site + r"[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(host == "", F.regexp_extract(url, r"^([^#]*)", 1)).otherwise(key)


def record_id(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: str | None, url: str, payload: bytes, refers_to: str | None, told: tuple[int, bytes]) -> bytes:
    """One WARC/1.1 record, not compressed. refers_to: the response's page id for a revisit, else None. Ids are texts, quoted as URLs are.

    told: length and SHA-1 of the whole payload, which a revisit names but doesn't hold.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {told[0]}\r\n\r\n".encode()
    digest = base64.b32encode(told[1]).decode()
    if refers_to is None and len(payload) != told[0]:
        raise ValueError(f"the payload of page {page_id} isn't whole")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {quote(refers_to, safe='')}"]
    body = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, plus http (lower-case names too) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields | {"http": {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive per task; yields (key, page_id, file, offset, length). Payloads are taken one by one from Arrow's memory."""
    name, rows, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
    first = next(batches, None)
    if first is None:
        return
    with new_file(folder, name) as out:
        while first is not None:
            page, url, html, key, refers, size, digest = (first.column(c) for c in ("page_id", "url", "html", "key", "refers_to", "bytes", "digest"))
            for i in range(first.num_rows):
                told = (size[i].as_py(), bytes.fromhex(digest[i].as_py()))
                packed = gzip.compress(make_record(page[i].as_py(), url[i].as_py() or "", (html[i].as_py() or "").encode(), refers[i].as_py(), told), 6, mtime=0)
                out.write(packed)
                rows.append((key[i].as_py(), page[i].as_py(), name, offset, len(packed)))
                offset += len(packed)
            first = next(batches, None)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                                         ["key", "page_id", "file", "offset", "length"])


def _write_index(batches: Iterator[pa.RecordBatch], folder: str, block: int) -> Iterator[pa.RecordBatch]:
    """One index file per range partition; yields (file, first_key, last_key)."""
    batches = (b for b in batches if b.num_rows)
    batch = next(batches, None)
    if batch is None:
        return
    name, directory, lines, offset, last = f"{uuid.uuid4().hex}.index", [], [], 0, None

    def flush(out) -> int:
        packed = zlib.compress("\n".join(lines).encode(), 6)
        directory.append([json.loads(lines[0])[0], offset, len(packed)])
        out.write(packed)
        lines.clear()
        return offset + len(packed)

    with new_file(folder, name) as out:
        while batch is not None:
            for r in batch.to_pylist():
                last = r["key"]
                lines.append(json.dumps([r["key"], r["file"], r["offset"], r["length"]]))
                if len(lines) == block:
                    offset = flush(out)
            batch = next(batches, None)
        if lines:
            offset = flush(out)
        sparse = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(sparse + struct.pack("<QQ", offset, len(sparse)))
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last])], ["file", "first_key", "last_key"])


@dataclass(frozen=True)
class Archive:
    """A folder of archives and index files, with the upper level of the index: (first_key, last_key, file), sorted."""

    folder: str
    upper: tuple[tuple[str, str, str], ...]


def write_archive(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
                  min_revisit_bytes: int = MIN_REVISIT_BYTES, block: int = BLOCK) -> tuple[Archive, DataFrame]:
    """Write all pages; returns the archive and the entries (key, page_id, file, offset, length).

    Null payloads and urls are empty. A null page id is kept as a record without an id, and refers to the response of its payload if there is one. Rows repeated
    with one id and payload are all responses or all revisits. Payloads are compared by SHA-1 and length.
    """
    spark = pages.sparkSession
    folder = make_folder(shared_folder(spark, "warc"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "digest": F.sha1("html"), "bytes": F.octet_length("html"),
                             "run": F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(RUNS)).cast("int")})
    group = ["digest", "bytes"]
    leaves = materialise(rows.groupBy("run", *group).agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")), "payloads")
    best = materialise(leaves.groupBy(*group).agg(F.max("page_id").alias("keep"), F.sum("n").alias("n")), "best")
    # only payloads that may occur twice are joined, and of these only what may be the response takes its payload along
    twice = hash_filter(best.where("n > 1"), F.col("digest"))
    joined = passing(best, F.col("digest"), twice)
    whole = materialise(hash_filter(joined, F.struct(*group, F.col("keep").alias("page_id"))), "responses").withColumnsRenamed({"slot": "at", "word": "bits"})
    told = leaves.join(joined.select(*group, "keep"), group).select("run", *group, "keep")
    once = passing(rows, F.col("digest"), twice, passes=False).withColumn("refers_to", F.lit(None).cast(pages.schema[id_column].dataType))
    h = F.xxhash64(F.struct(*group, "page_id"))
    kept = (F.getbit("bits", F.shiftrightunsigned(h, 58).cast("int")) == 1) | (F.col("bytes") < min_revisit_bytes)
    often = passing(rows, F.col("digest"), twice).join(F.broadcast(whole), F.pmod(h, F.lit(FILTER_ROWS)) == F.col("at"), "left")
    often = often.withColumn("html", F.when(kept, F.col("html"))).drop("at", "bits").join(told, ["run", *group]).withColumn(
        "refers_to", F.when((F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    marked = once.unionByName(often.select(*once.columns))
    kind = pages.schema[id_column].dataType
    marked = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "key", F.col("refers_to").cast("string").alias("refers_to"), "bytes", "digest")
    entries = materialise(marked.mapInArrow(partial(_write, folder=folder), "key string, page_id string, file string, offset long, length long")
                          .withColumn("page_id", F.col("page_id").cast(kind)), "entries")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), entries.count() // (4 * block) + 1))
    ranged = entries.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    upper = materialise(ranged.mapInArrow(partial(_write_index, folder=folder, block=block), "file string, first_key string, last_key string"), "index")
    return Archive(folder, tuple(sorted((r["first_key"], r["last_key"], r["file"]) for r in upper.collect()))), entries


def _files_of(batches: Iterator[pa.RecordBatch], archive: Archive) -> Iterator[pa.RecordBatch]:
    """(file, key) for every index file whose range holds the key."""
    firsts, lasts = [u[0] for u in archive.upper], [u[1] for u in archive.upper]
    for batch in batches:
        pairs = [(archive.upper[i][2], k) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["file", "key"])


class IndexFile:
    """Bisection in the sparse directory of one index file; the last block stays unpacked."""

    def __init__(self, read: RangeReader, name: str):
        self.read, self.name, self.at, self.lines = read, name, -1, []
        size = read.size(name)
        offset, length = struct.unpack("<QQ", read(name, size - 16, 16))
        self.directory = json.loads(zlib.decompress(read(name, offset, length)))
        self.firsts = [d[0] for d in self.directory]

    def block(self, i: int) -> list[list]:
        if i != self.at:
            _, offset, length = self.directory[i]
            self.lines = [json.loads(x) for x in zlib.decompress(self.read(self.name, offset, length)).decode().split("\n")]
            self.at = i
        return self.lines

    def find(self, key: str) -> Iterator[list]:
        """Entries [key, file, offset, length] of a key: from the block before the first that begins with it."""
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            lines = self.block(i)
            low = bisect_left(lines, key, key=lambda x: x[0])
            yield from lines[low : bisect_right(lines, key, low, key=lambda x: x[0])]


def _search(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    read, index = RangeReader(folder), None
    names = ["key", "file", "offset", "length"]
    for batch in batches:
        found = []
        for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if index is None or index.name != name:
                index = IndexFile(read, name)
            for entry in index.find(key):
                found.append(entry)
                if len(found) == 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found])
                    found = []
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found])
    read.close()


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of all captures of the url keys (column key; repeated keys count once)."""
    files = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(partial(_files_of, archive=archive), "file string, key string")
    dealt = files.repartition("file").sortWithinPartitions("file", "key")
    return dealt.mapInArrow(partial(_search, folder=archive.folder), "key string, file string, offset long, length long")


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    """One range of about ``READ_BYTES`` at a time; what its records say goes on, their payloads only if asked for."""
    read = RangeReader(folder)
    ids = lambda x: None if x is None else unquote(x)
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payloads)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", *["payload"] * payloads)
    for batch in batches:
        rows = batch.to_pylist()
        i = 0
        while i < len(rows):
            j, end = i + 1, rows[i]["offset"] + rows[i]["length"]
            while j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] == end and end - rows[i]["offset"] < READ_BYTES:
                end += rows[j]["length"]
                j += 1
            raw, low = read(rows[i]["file"], rows[i]["offset"], end - rows[i]["offset"]), rows[i]["offset"]
            out = []
            for r in rows[i:j]:
                record = parse_record(gzip.decompress(raw[r["offset"] - low : r["offset"] - low + r["length"]]))
                told = record["warc-payload-digest"].removeprefix("sha1:")
                if record["warc-type"] == "response" and told != base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode():
                    raise ValueError(f"payload of {record['warc-record-id']} doesn't match its digest")
                body = [record["payload"] if record["warc-type"] == "response" else None] * payloads
                out.append((ids(record.get("x-page-id")), int(record["http"]["content-length"]), told, record["warc-type"],
                            ids(record.get("x-refers-to-page")), record["warc-target-uri"], *body))
            i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))
    read.close()


def read_records(archive: Archive, captures: DataFrame, id_type: T.DataType | str = "long", payloads: bool = False,
                 task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records at (file, offset, length), read in order of place: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, and
    the payload if asked for. Captures are dealt to tasks of about ``task_bytes`` of archive each."""
    total = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(total // task_bytes + 1, min(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total >> 20) + 1))
    dealt = captures.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string" + ", payload binary" * payloads
    found = dealt.mapInArrow(partial(_read, folder=archive.folder, payloads=payloads), schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, look every url key up in the index and read the captures back; page ids may be of any type that casts to text and back."""
    archive, entries = write_archive(pages)
    captures = materialise(lookup(archive, entries), "captures")
    found = read_records(archive, captures, pages.schema["page_id"].dataType)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, octet_length(b) AS n, max(page_id) AS keep FROM p GROUP BY ALL),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, h, keep, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM p JOIN k USING (h))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
    1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS BIGINT) * CAST(16 >> CAST(j AS BIGINT) AS BIGINT)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d
"""
