"""WARC archives: a writer with payload de-duplication and a salvage reader.

The writer puts every page in a record of its own gzip member; tasks roll their files at a size and report them in a
manifest, so that only files of tasks that succeeded are ever read. Of records with equal payloads one is a response,
the others are revisits that name it.

The reader takes files one at a time through a window of bounded size, and holds of a record only its header and, where
the payload is asked for, that. A record passes when its member inflates with
the right checksum (or, in plain files, its length leads to the record's end), its header parses, and its digests
match. After a failed check the reader searches on for the next valid member or version line, recovers what follows,
and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shared_path, ship
from .arrow import small_batches

_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STEP = 1 << 20
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_END = b"\r\n\r\n"
_ID = "urn:page:"
MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, start long, stop long, kind string, record_id string, record_type string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, reason string, payload binary"
)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, payload_digest: str | None = None) -> bytes:
    """A response record, or a revisit of the page `refers_to`; a revisit keeps the HTTP header alone."""
    payload_digest = payload_digest or digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """data as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Parsed:
    """A record as read, or the reason why it is none."""

    stop: int = 0
    reason: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None  # None where it wasn't asked for
    size: int = 0
    sha: str = ""


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for x in lines:
        if x[:1] in (b" ", b"\t") and last:
            out[last] += " " + x.strip().decode("utf-8", "replace")
            continue
        name, colon, value = x.partition(b":")
        if colon:
            last = name.strip().decode("latin-1").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


class Body:
    """A record's block as it comes in: its digest, its HTTP header, and the payload's size and digest."""

    def __init__(self, headers: dict[str, str], keep: bool):
        self.keep, self.block, self.payload = keep, hashlib.sha1(), hashlib.sha1()
        self.size, self.parts = 0, []
        self.head: bytearray | None = bytearray() if "application/http" in headers.get("content-type", "") else None
        self.http: dict[str, str] = {}

    def feed(self, data: bytes) -> None:
        self.block.update(data)
        if self.head is not None:
            seen = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(_END, seen)
            if end < 0:
                return
            data, self.http, self.head = bytes(self.head[end + 4 :]), _fields(bytes(self.head[:end]).split(b"\r\n")[1:]), None
        self.payload.update(data)
        self.size += len(data)
        if self.keep:
            self.parts.append(data)

    def checked(self, headers: dict[str, str], stop: int, at: int) -> Parsed:
        """The record, if its digests are right. A block without the end of an HTTP header has an empty payload."""
        name = lambda h: base64.b32encode(h.digest()).decode()
        want = headers.get("warc-block-digest", "")
        if want.startswith("sha1:") and want[5:] != name(self.block):
            return Parsed(at, "block digest")
        want = headers.get("warc-payload-digest", "")
        if headers["warc-type"] == "response" and want.startswith("sha1:") and want[5:] != name(self.payload):
            return Parsed(at, "payload digest")
        return Parsed(stop, "", headers, self.http, b"".join(self.parts) if self.keep else None, self.size, name(self.payload))


def _headers(head: bytes) -> dict[str, str] | None:
    """A record's header fields, None if those that every record has are missing or a line is no field."""
    lines = head.split(b"\r\n")[1:]
    if not all(b":" in x or x[:1] in (b" ", b"\t") for x in lines):
        return None
    out = _fields(lines)
    return out if "warc-type" in out and "warc-record-id" in out else None


def _length(head: bytes) -> int:
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|\Z)", head, re.I)
    return int(m[1]) if m else -1


class Source:
    """Random access to a file's bytes, with a window of what was read last."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.window = f, size, 0, b""
        self.searched = (1, 0, -1)  # what head_end() found last: from, to, result

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.window)):
            self.f.seek(start)
            self.at, self.window = start, self.f.read(max(n, _STEP))
        return self.window[start - self.at : start - self.at + n]

    def head_end(self, at: int) -> int:
        """Where the header that begins here ends; -1 if the file ends or a control character comes before."""
        first, last, found = self.searched
        if first <= at <= last:
            return found
        p, found = at, -1
        while p < self.size:
            data = self.get(p, _STEP)
            end = data.find(_END)
            bad = _CONTROL.search(data, 0, end if end >= 0 else len(data))
            if end >= 0 or bad:
                found = -1 if bad else p + end
                p += bad.start() if bad else end
                break
            p += max(1, len(data) - 3)
        self.searched = (at, p, found)
        return found


def parse_plain(src: Source, at: int, keep: bool = True) -> Parsed:
    """The uncompressed record at a place."""
    if not _VERSION.match(src.get(at, 16)):
        return Parsed(at, "no version line")
    near = src.get(at + 10, 4096)
    again = _VERSION.search(near)
    if again and _END not in near[: again.start()]:
        return Parsed(at, "header")  # another record begins in it
    end = src.head_end(at)
    head = src.get(at, end - at) if end >= 0 else b""
    n = _length(head)
    if end < 0 or n < 0:
        return Parsed(at, "header")
    first = end + 4
    if first + n > src.size:
        return Parsed(at, "cut off")
    if src.get(first + n, 4) != _END:
        return Parsed(at, "length")
    headers = _headers(head)
    if headers is None:
        return Parsed(at, "header incomplete")
    body = Body(headers, keep)
    for p in range(first, first + n, _STEP):
        body.feed(src.get(p, min(_STEP, first + n - p)))
    return body.checked(headers, first + n + 4, at)


def parse_member(src: Source, at: int, keep: bool = True) -> Parsed:
    """The record in the gzip member at a place. No more of it is unpacked than its header announces."""
    if src.get(at, 3) != _MEMBER:
        return Parsed(at, "no member")
    z, p = zlib.decompressobj(31), at
    head, body, headers, left, tail = bytearray(), None, None, 0, b""
    try:
        while not z.eof:
            raw = z.unconsumed_tail or src.get(p, 1 << 16)
            if not raw:
                return Parsed(at, "cut off")
            if not z.unconsumed_tail:
                p += len(raw)
            data = z.decompress(raw, 1 << 20)
            if body is None:
                seen = max(0, len(head) - 3)
                head += data
                if len(head) >= 10 and not _VERSION.match(head):
                    return Parsed(at, "no version line")
                end = head.find(_END, seen)
                if _CONTROL.search(head, seen, end if end >= 0 else len(head)):
                    return Parsed(at, "record in member")
                if end < 0:
                    continue
                data, top = bytes(head[end + 4 :]), bytes(head[:end])
                left, headers = _length(top), _headers(top)
                if left < 0 or headers is None:
                    return Parsed(at, "record in member" if left < 0 else "header incomplete")
                body, head = Body(headers, keep), bytearray()
            body.feed(data[:left])
            tail += data[left:]
            left -= min(left, len(data))
            if len(tail) > 4:
                return Parsed(at, "record in member")
    except zlib.error as e:
        return Parsed(at, f"member: {str(e)[:60]}")
    if body is None or left or tail not in (_END, b""):
        return Parsed(at, "record in member")
    return body.checked(headers, p - len(z.unused_data), at)


def salvage(src: Source, keep: bool = True) -> Iterator[tuple[int, int, Parsed]]:
    """(start, stop, record or failure) over a file, compressed, plain or mixed; failures are the quarantined gaps."""
    at = 0

    def parse(p: int) -> Parsed:
        first = src.get(p, 3)
        return parse_member(src, p, keep) if first == _MEMBER else parse_plain(src, p, keep)

    def candidates(p: int) -> Iterator[int]:
        while p < src.size:
            data = src.get(p, _STEP)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", data):
                yield p + m.start()
            if p + len(data) >= src.size:
                return
            p += max(1, len(data) - 9)

    while at < src.size:
        got = parse(at)
        if not got.reason:
            yield at, got.stop, got
            at = got.stop
            continue
        reason, then = got.reason, src.size
        tried = at
        for c in candidates(at + 1):
            if c <= tried:
                continue
            tried = c
            got = parse(c)
            if not got.reason:
                then = c
                break
        yield at, then, Parsed(then, reason)
        at = then
        if at < src.size:
            yield at, got.stop, got
            at = got.stop


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path[5:]
    return pyarrow.fs.LocalFileSystem(), path


def _write_task(folder: str, most_file: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        size = n = 0

        def reported() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

        for b in small_batches(batches, "html"):
            for page_id, url, page, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0  # an attempt's own name
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, url, (page or "").encode(), refers_to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= most_file:
                    yield reported()
                    out = None
        if out is not None:
            yield reported()

    return run


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "utf-8")


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, d, refers_to) of the pages whose payload of at least `least_bytes` bytes a smaller page_id has too; d
    is the payload's SHA-1."""
    p = pages.select("page_id", _payload().alias("p")).where(F.col("page_id").isNotNull() & (F.octet_length("p") >= least_bytes))
    d = materialize(p.select("page_id", F.sha1("p").alias("d")), "digests")
    first = d.groupBy("d").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("d", "first")
    first = materialize(first, "first-pages")  # as a table of its own, so that Spark can split a hot payload's rows in the join
    return d.join(first, "d").where(F.col("page_id") != F.col("first")).select("page_id", "d", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, most_file: int = 128 << 20) -> DataFrame:
    """Write pages (page_id, url, html) to archives below folder; returns the manifest (path, bytes, records).

    Null html counts as empty. Of records with equal payloads of at least `least_bytes` bytes, those with the smallest
    page_id are responses and the others revisits; rows that repeat a page_id with another payload are responses.
    Pages without an id are responses. Other columns are ignored; an empty table gives an empty manifest.
    """
    ship(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    old = originals(p, least_bytes).withColumnRenamed("page_id", "of")
    known = p.where("page_id is not null")  # those without an id refer to none and needn't meet in one task
    rows = known.join(old, (F.col("page_id") == F.col("of")) & (F.sha1(_payload()) == F.col("d")), "left").select("page_id", "url", "html", "refers_to")
    rows = rows.unionByName(p.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))
    return materialize(rows.mapInArrow(_write_task(folder, most_file), MANIFEST), "manifest")


def _read_task(with_payload: bool) -> Callable:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(path: str, start: int, stop: int, got: Parsed) -> tuple:
        if got.reason:
            return (path, start, stop, "gap", *[None] * 6, got.reason, None)
        h, bare = got.headers, lambda x: x.strip("<>") if x else None
        revisit = h["warc-type"] == "revisit"
        told = got.http.get("content-length", "")
        size = (int(told) if re.fullmatch("[0-9]{1,18}", told) else None) if revisit else got.size
        sha = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else got.sha
        return path, start, stop, "record", bare(h["warc-record-id"]), h["warc-type"], bare(h.get("warc-refers-to")), h.get("warc-target-uri"), size, sha, None, got.payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = _file_system(path)
                held, size = [], 0
                out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                try:
                    f = fs.open_input_file(name)
                except FileNotFoundError:  # other faults may pass, and the task is run again
                    yield out([row(path, 0, 0, Parsed(0, "no such file"))])
                    continue
                with f:
                    for x in salvage(Source(f, f.size()), with_payload):
                        held.append(row(path, *x))
                        size += len(held[-1][-1] or b"")
                        if size > 4 << 20 or len(held) >= 4096:
                            yield out(held)
                            held, size = [], 0
                if held:
                    yield out(held)

    return run


def read(files: DataFrame, with_payload: bool = True, files_a_task: int = 4) -> DataFrame:
    """Records and gaps of archives (column path), a task for every few files; their number decides, not the manifest's
    bytes.

    kind is "record" or "gap" (quarantined bytes from start to stop, with the reason of the first failed check). An
    empty file gives no rows; a file that is no archive at all is one gap, and so is one that doesn't exist. A revisit
    whose HTTP header has no length that can be read has a null payload_bytes. Repeated paths are read once. A record
    may have any length; where payloads are asked for, a row holds one.
    """
    spark: SparkSession = files.sparkSession
    ship(spark)
    paths = materialize(files.select("path").distinct(), "paths")
    n = paths.count()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // files_a_task)))
    return paths.repartition(tasks).mapInArrow(_read_task(with_payload), RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    manifest = write(pages, shared_path(pages.sparkSession, "warc"), least_bytes)
    r = read(manifest, with_payload=False).where("kind = 'record'")
    page = lambda c: F.when(F.length(F.col(c)) > len(_ID), F.substr(F.col(c), F.lit(len(_ID) + 1))).cast("long")
    return r.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
