"""Web archives with a two-level capture index.

Archives are gzip files with one member per WARC record.  Captures with equal
payloads are kept once: the one with the smallest page_id as response, the
others as revisits that name it.

The index sorts one line per record by reversed-host URL key (com,example)/path)
over range partitions.  Each index file holds compressed blocks of lines, then a
sparse directory with the first key of every block.  A lookup binary-searches
the files' first keys, then a directory, reads one block and then the record's
bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise, stage_path
from cellframe.llm.common import open_store, put_file, rows_of

LEAST_REVISIT = 100
BLOCK_LINES = 1000
ARCHIVE_BYTES = 64_000_000
DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, a bracket, then path and query in lower case; the whole string if it has no host."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
        port = u.port
    except ValueError:
        host = ""
    if not host:
        return (url or "").strip().lower()
    tail = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as its own gzip member; the same input gives the same bytes."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        "WARC-Target-URI: " + quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:] if ": " in x)


def parse(member: bytes) -> dict:
    """Fields of a record, payload size and digest from the payload itself, or, of a revisit, from the headers kept."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI", ""), "record_type": h["WARC-Type"], "refers_to": None, "payload": None}
    if h["WARC-Type"] == "revisit":
        size, digest = int(headers(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
        return out | {"refers_to": number(h["WARC-Refers-To"]), "payload_bytes": size, "payload_digest": digest}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


LINE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("name", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
BLOCK = pa.schema([
    ("folder", pa.string()), ("part", pa.string()), ("first_key", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("lines", pa.int64()),
])


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and index; return the block directory, a written table.

    A null html is an empty payload, a null url has the empty key, a null
    page_id is kept and never referred to.  Repeated rows give repeated records.
    Payloads under 100 bytes are always responses.  No pages give no files.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"),
    )
    first = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = materialise(first.where("copies > 1").select("digest", "first"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = total // archive_bytes + 1
    refers = F.when((F.col("n") >= LEAST_REVISIT) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    placed = (
        rows.join(first, "digest", "left")
        .select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.pmod(F.xxhash64("page_id", "digest"), F.lit(files)).cast("int").alias("file"))
        .repartitionById(files, F.col("file")).sortWithinPartitions("file", "page_id", "digest", "url")
    )
    folder = stage_path(spark, "captures")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, lines, at, file = [], {c: [] for c in LINE.names}, 0, None

        def flush() -> pa.RecordBatch:
            put_file(folder, f"{file:06d}.warc.gz", members, uuid.uuid4().hex)
            return pa.RecordBatch.from_pydict(lines, schema=LINE)

        for cols in rows_of(batches):
            for page_id, url, html, digest, refers_to, f in zip(*(cols[c] for c in ("page_id", "url", "html", "digest", "refers_to", "file")), strict=True):
                if f != file and members:
                    yield flush()
                    members, lines, at = [], {c: [] for c in LINE.names}, 0
                file = f
                members.append(record(page_id, url, html.encode(), digest, refers_to))
                for c, v in zip(LINE.names, (url_key(url), page_id, f"{file:06d}.warc.gz", at, len(members[-1])), strict=True):
                    lines[c].append(v)
                at += len(members[-1])
        if members:
            yield flush()

    index = materialise(placed.mapInArrow(save, "key string, page_id long, name string, start long, length long"))

    def save_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"index-{TaskContext.get().partitionId():06d}"
        parts, directory, lines, at = [], [], [], 0

        def close() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode())
            directory.append((json.loads(lines[0])[0], at, len(block), len(lines)))
            parts.append(block)
            at += len(block)
            lines.clear()

        for cols in rows_of(batches, block_lines):
            for row in zip(*(cols[c] for c in LINE.names), strict=True):
                lines.append(json.dumps(row))
                if len(lines) == block_lines:
                    close()
        if lines:
            close()
        if directory:
            tail = zlib.compress(json.dumps(directory).encode())
            put_file(folder, part, [*parts, tail, len(tail).to_bytes(8, "little")], uuid.uuid4().hex)
            keys, starts, lengths, counts = map(list, zip(*directory, strict=True))
            k = len(directory)
            yield pa.RecordBatch.from_pydict({"folder": [folder] * k, "part": [part] * k, "first_key": keys, "start": starts, "length": lengths, "lines": counts}, schema=BLOCK)

    ordered = index.repartitionByRange(files * 2, "key", "page_id", "name", "start").sortWithinPartitions("key", "page_id", "name", "start")
    return materialise(ordered.mapInArrow(save_index, "folder string, part string, first_key string, start long, length long, lines long"))


class Archive:
    """Records of a written archive folder by range reads."""

    OPEN_FILES = 32

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def bytes_at(self, name: str, start: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.OPEN_FILES:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.store.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, start)

    def block(self, part: str, start: int, length: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.bytes_at(part, start, length)).decode().split("\n")]

    def directory(self, part: str) -> list[list]:
        """First key, start, length and lines of each block, from the end of an index file."""
        with self.store.open_input_file(f"{self.root}/{part}") as f:
            size = f.size()
            n = int.from_bytes(f.read_at(8, size - 8), "little")
            return json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))

    def lookup(self, parts: list[tuple[str, str]], url: str) -> list[dict]:
        """Records of one URL; ``parts`` has first key and name of each index file, sorted."""
        key, out = url_key(url), []
        for k in range(max(0, bisect_left(parts, (key, "")) - 1), len(parts)):
            if parts[k][0] > key:
                break
            blocks = self.directory(parts[k][1])
            firsts = [b[0] for b in blocks]
            for b in range(max(0, bisect_left(firsts, key) - 1), len(blocks)):
                if firsts[b] > key:
                    break
                lines = self.block(parts[k][1], blocks[b][1], blocks[b][2])
                out += [parse(self.bytes_at(*x[2:])) for x in lines[bisect_left(lines, key, key=lambda x: x[0]) :] if x[0] == key]
        return out


def index_parts(directory: DataFrame) -> list[tuple[str, str]]:
    """First key and name of each index file: one row per file, for ``Archive.lookup``."""
    rows = directory.groupBy("part").agg(F.min("first_key").alias("first_key")).collect()
    return sorted((r.first_key, r.part) for r in rows)


def read(directory: DataFrame) -> DataFrame:
    """Every record, found through the index and read back from the archives.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for cols in rows_of(batches, 1):
            archive = archive or Archive(cols["folder"][0])
            lines = sorted(archive.block(cols["part"][0], cols["start"][0], cols["length"][0]), key=lambda x: x[2:4])
            found = [parse(archive.bytes_at(*x[2:])) for x in lines]
            yield pa.RecordBatch.from_pydict({c: [f[c] for f in found] for c in out.names}, schema=out)

    spread = directory.repartition(4 * max(2, directory.sparkSession.sparkContext.defaultParallelism), "part", "start")
    return spread.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
