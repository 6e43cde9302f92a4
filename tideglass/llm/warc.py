"""WARC archives with a two-level capture index.

``write`` stores a record per page as a gzip member of a WARC file in a shared folder. Of pages of
equal payload of at least ``least`` bytes the one of largest id is stored as a response, the others
as revisits that name it. Each capture's place is then indexed: reversed-host URL keys are sorted over
the cluster into compressed blocks, and each index file has a sparse directory of its blocks' first
keys. ``read`` finds captures again: requests are sorted by the same keys, each task looks up the index
files' first keys, then binary-searches a file's directory and reads the block by range. The places found are sorted by file
and offset, and each task reads its stretch of the archives in ranges that hold neighbouring records.

Files are written under names of their own by each task attempt, and only those that a finished task
reports are listed, so lost executors and repeated tasks do no harm. Files are reached through Arrow's
file systems, so the folder may be a shared mount or an object store.

Defined cases: a null payload is empty; a null URL has the empty key; rows that repeat a page id are
captures each, told apart by a capture number; if they share a payload and the largest id, all of them
are responses and a revisit names that id; a null page id is smaller than all others; an empty table
gives empty archives and an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, scratch_path
from .words import slices

LEAST = 1000
BLOCK_LINES = 512
FILE_BYTES = 256_000_000
#: Captures of an index file; requests and bytes of archives that one task takes.
INDEX_ROWS, TASK_ROWS, TASK_BYTES = 32_768, 16_384, 64_000_000
#: Records are read in one range while it stays this long and they lie this close.
RANGE_BYTES, GAP_BYTES = 4_000_000, 32_768
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_WHEN = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
_CAPTURE = "urlkey string, capture long, page_id long, file string, offset long, length long, digest string, type string, refers_to long"


@dataclass(frozen=True)
class Archive:
    """folder: of the files; captures: places of the records; index: the index files' first keys and places."""

    folder: str
    captures: DataFrame
    index: DataFrame


def url_key(url: str | None) -> str:
    """The host reversed by labels, then the path and query: com,example,www)/a?b."""
    parts = urlsplit(url or "")
    try:
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        host, port = parts.netloc, None
    if not host:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path.lower() or '/'}{query.lower()}"


def _safe_key(url: str | None) -> str:
    try:
        key = url_key(url)
    except ValueError:
        key = (url or "").lower()
    return key.replace("\n", "%0A").replace("\r", "%0D").replace("\x00", "%00")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _record_id(page: int | None, capture: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{capture}')}>"


def record(kind: str, url: str | None, page: int | None, capture: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    body = _HEAD + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page, capture)}",
        f"WARC-Date: {_WHEN}",
        f"WARC-Target-URI: {(url or '').replace(chr(10), '%0A').replace(chr(13), '%0D')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page is None else page}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"] if kind == "revisit" else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _packed(data: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, digest, capture, type, refers_to. The payloads move once, by digest; those of
    fewer than ``least`` bytes have keys of their own, and large groups of copies are split by Spark's
    skew handling because only one row per digest is on the other side."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    base = base.withColumn("_big", F.octet_length("payload") >= least)
    chosen = base.filter("_big").groupBy("digest").agg(F.max("page_id").alias("_chosen"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("digest").alias("_key"), "_chosen")
    key = F.when(F.col("_big"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = base.withColumn("_key", key).join(chosen, "_key", "left")
    revisit = F.coalesce(F.col("_chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_chosen")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("_chosen")).alias("refers_to"))


def _write_records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    store, root = _store(folder)
    part, n, out, name, at = TaskContext.get().partitionId(), 0, None, "", 0
    for b in slices(batches, 64):
        rows = []
        for r in b.to_pylist():
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            capture = part << 33 | n
            n += 1
            data = _packed(record(r["type"], r["url"], r["page_id"], capture, r["payload"], r["digest"], r["refers_to"]))
            out.write(data)
            rows.append({"urlkey": _safe_key(r["url"]), "capture": capture, "page_id": r["page_id"], "file": name, "offset": at, "length": len(data), "digest": r["digest"], "type": r["type"], "refers_to": r["refers_to"]})
            at += len(data)
        yield pa.RecordBatch.from_pylist(rows, _ARROW_CAPTURE)
    if out is not None:
        out.close()


_ARROW_CAPTURE = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _CAPTURE.split(", "))])


def _key_line(urlkey: str, page_id: int | None, capture: int) -> tuple[str, int, int]:
    return (urlkey, -1 if page_id is None else page_id, capture)


def _write_index(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """A file of compressed blocks and its directory, from captures in key order."""
    from pyspark import TaskContext

    store, root = _store(folder)
    name, out, at, held, directory = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, [], []

    def flush() -> None:
        nonlocal at, held
        data = _packed("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode("utf-8", "surrogatepass"))
        out.write(data)
        directory.append((held[0][:3], at, len(data)))
        at, held = at + len(data), []

    for b in slices(batches):
        for r in b.to_pylist():
            if out is None:
                out = store.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            held.append([*_key_line(r["urlkey"], r["page_id"], r["capture"]), r["file"], r["offset"], r["length"]])
            if len(held) >= lines:
                flush()
    if out is None:
        return
    if held:
        flush()
    out.close()
    with store.open_output_stream(f"{root}/{name}.dir.gz", compression=None) as d:
        d.write(_packed(json.dumps(directory).encode()))
    first = directory[0][0]
    yield pa.RecordBatch.from_pylist([{"urlkey": first[0], "page_id": first[1], "capture": first[2], "name": name}])


def _sorted(df: DataFrame, rows: int) -> DataFrame:
    """By key, about ``rows`` rows a task, whatever few bytes they have."""
    keys = ["urlkey", F.coalesce("page_id", F.lit(-1)), "capture"]
    return df.repartitionByRange(max(1, math.ceil(df.count() / rows)), *keys).sortWithinPartitions(*keys)


def write(pages: DataFrame, folder: str | None = None, *, least: int = LEAST, lines: int = BLOCK_LINES) -> Archive:
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    captures = materialise(_decided(pages, least).mapInArrow(lambda it: _write_records(it, folder), _CAPTURE), "captures")
    index = _sorted(captures, INDEX_ROWS).mapInArrow(lambda it: _write_index(it, folder, lines), "urlkey string, page_id long, capture long, name string")
    return Archive(folder, captures, materialise(index, "index"))


class _Finder:
    """Binary search in the index files' first keys, a file's directory, and a block; one of each is kept."""

    def __init__(self, folder: str, firsts: list[tuple[tuple[str, int, int], str]]):
        self._store, self._root = _store(folder)
        self._firsts = firsts
        self._keys = [f[0] for f in firsts]
        self._name, self._directory, self._at, self._block = "", [], -1, []

    def find(self, key: tuple[str, int, int]) -> tuple[str, int, int] | None:
        i = bisect.bisect_right(self._keys, key) - 1
        if i < 0:
            return None
        if self._firsts[i][1] != self._name:
            self._name, self._at = self._firsts[i][1], -1
            with self._store.open_input_file(f"{self._root}/{self._name}.dir.gz") as f:
                self._directory = [(tuple(k), at, n) for k, at, n in json.loads(gzip.decompress(f.read()))]
            self._starts = [d[0] for d in self._directory]
        j = bisect.bisect_right(self._starts, key) - 1
        if j != self._at:
            _, at, n = self._directory[j]
            self._at = j
            self._block = [(tuple(x[:3]), x[3:]) for x in map(json.loads, gzip.decompress(self.range(f"{self._name}.cdx.gz", at, n)).decode("utf-8", "surrogatepass").split("\n"))]
        k = bisect.bisect_left(self._block, key, key=lambda e: e[0])
        return tuple(self._block[k][1]) if k < len(self._block) and self._block[k][0] == key else None

    def range(self, name: str, at: int, n: int) -> bytes:
        with self._store.open_input_file(f"{self._root}/{name}") as f:
            f.seek(at)
            return f.read(n)


def _fetched(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Records of places that come by file and offset."""
    store, root = _store(folder)
    name, f = "", None
    for b in slices(batches, 512):
        places, lo = b.to_pylist(), 0
        while lo < len(places):
            first, hi = places[lo], lo + 1
            end = first["offset"] + first["length"]
            while hi < len(places) and places[hi]["file"] == first["file"] and places[hi]["offset"] - end <= GAP_BYTES and places[hi]["offset"] + places[hi]["length"] - first["offset"] <= RANGE_BYTES:
                end = max(end, places[hi]["offset"] + places[hi]["length"])
                hi += 1
            if first["file"] != name:
                if f is not None:
                    f.close()
                name, f = first["file"], store.open_input_file(f"{root}/{first['file']}")
            f.seek(first["offset"])
            data, rows = f.read(end - first["offset"]), []
            for p in places[lo:hi]:
                at = p["offset"] - first["offset"]
                fields, payload = parse(gzip.decompress(data[at : at + p["length"]]))
                kind, target = fields["WARC-Type"], fields.get("X-Refers-To-Page")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {p['page_id']} does not match its digest")
                rows.append({"page_id": p["page_id"], "digest": digest, "type": kind, "refers_to": int(target) if target else None, "payload": payload if kind == "response" else None})
            yield pa.RecordBatch.from_pylist(rows, _ARROW_READ)
            lo = hi
    if f is not None:
        f.close()


def read(archive: Archive, requests: DataFrame | None = None) -> DataFrame:
    """page_id, payload_digest, record_type, refers_to, payload: the captures that
    ``requests`` (urlkey, page_id, capture; by default all) name, found through the index.

    The list of index files, one entry per ``INDEX_ROWS`` captures, is broadcast.
    """
    requests = archive.captures.select("urlkey", "page_id", "capture") if requests is None else requests
    spark = requests.sparkSession
    firsts = sorted(((r["urlkey"], r["page_id"], r["capture"]), r["name"]) for r in archive.index.collect())
    shared, folder = spark.sparkContext.broadcast(firsts), archive.folder

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(folder, shared.value)
        for b in slices(batches):
            found = [(r["page_id"], finder.find(_key_line(r["urlkey"], r["page_id"], r["capture"]))) for r in b.to_pylist()]
            rows = [{"page_id": page, **dict(zip(("file", "offset", "length"), place, strict=True))} for page, place in found if place is not None]
            yield pa.RecordBatch.from_pylist(rows, _ARROW_PLACE)

    places = materialise(_sorted(requests, TASK_ROWS).mapInArrow(lookup, "page_id long, file string, offset long, length long"), "places")
    total = places.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, math.ceil(total["n"] / TASK_ROWS), math.ceil(total["bytes"] / TASK_BYTES))
    got = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(lambda it: _fetched(it, folder), "page_id long, digest string, type string, refers_to long, payload binary")
    return got.select("page_id", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "payload")


_ARROW_PLACE = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ARROW_READ = pa.schema([("page_id", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digests(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all captures, read back through the
    index; a revisit's bytes are counted in the response that it names."""
    found = materialise(read(archive).withColumn("_bytes", F.octet_length("payload").cast("long")).drop("payload"), "read-back")
    named = found.filter("record_type = 'revisit'").select(F.col("payload_digest").alias("_digest")).distinct()
    targets = found.filter("record_type = 'response'").join(named, found["payload_digest"] == F.col("_digest"), "left_semi").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_of")).agg(F.max("_bytes").alias("_size"))
    back = found.join(targets, F.col("refers_to").eqNullSafe(F.col("_page")) & (F.col("record_type") == "revisit") & (F.col("payload_digest") == F.col("_of")), "left")
    return back.select("page_id", F.coalesce("_bytes", "_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
