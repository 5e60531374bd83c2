"""WARC archives: a writer with revisit records and a sequential reader.

``write`` puts one gzip member per record into archive files under the shared folder, a few per task, and returns the table
of files; only files of successful attempts are listed, so retries and lost executors leave no doubles. Payloads that occur
more than once are stored once: the smallest page_id keeps a response record and the others get revisit records, whose HTTP
header still tells the full length. ``read`` deals the files to tasks. A task streams its file: bytes are decompressed
incrementally, a record's header ends at the blank line, its block is framed by Content-Length, digests are computed while
the block passes and compared with the header's. No archive or block is held whole unless payloads are asked for.

Archives are opened by ``pyarrow.fs`` from the folder's URI, so local and remote shared folders work alike.

Defined results: null html is an empty payload; null url is an empty target; payloads shorter than ``min_revisit_bytes`` are
always responses; rows that repeat a page_id with an equal payload are all responses when that id is the smallest; null
page_ids order last and stay null; an empty table gives no files and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize, shared_dir

RECORD_ID = "urn:page:"
FILES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"
CHUNK = 1 << 18


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit when ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(whole) + deflate.flush()


def with_references(pages: DataFrame, min_revisit_bytes: int = 0, crowd: int = 10_000) -> DataFrame:
    """(page_id, url, html, refers_to): the page whose equal payload a page revisits, null for responses.

    Digests with several pages are few columns wide. Those with more than ``crowd`` pages (and more than one in 100,000 of all
    such pages, so at most 100,000 digests) are broadcast, and their pages are dealt out evenly; the others are joined by digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    firsts = rows.filter(F.octet_length("html") >= min_revisit_bytes).select("page_id", digest.alias("of")).groupBy("of").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = materialize(firsts)
    least = max(crowd, (firsts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot = F.broadcast(firsts.filter(F.col("n") > least).select(F.col("of").alias("hot_of"), F.col("first").alias("hot_first")))
    known = rows.withColumn("digest", digest).join(hot, F.col("digest") == F.col("hot_of"), "left")
    spread = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string")))
    joined = known.withColumn("key", spread).join(firsts.filter(F.col("n") <= least), F.col("key") == F.col("of"), "left")
    first = F.coalesce("hot_first", "first")
    refers = F.when(~first.eqNullSafe(F.col("page_id")), first)
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, min_revisit_bytes: int = 0, max_archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive all pages; the table (path, n_records, n_bytes) of the files written."""
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def archive(batches):
        store, folder = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        done, out, number, n, size = [], None, 0, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(folder, recursive=True)
                    path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number, n, size = store.open_output_stream(path), number + 1, 0, 0
                data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= max_archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        name = lambda path: f"{root}/{path.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_arrays([pa.array([name(x[0]) for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return materialize(with_references(pages, min_revisit_bytes).mapInArrow(archive, FILES))


class _Stream:
    """Decompressed bytes of a file of gzip members, pulled as needed."""

    def __init__(self, file):
        self.file, self.raw, self.held, self.inflate, self.ended = file, b"", bytearray(), None, False

    def fill(self) -> bool:
        """Decompress a little more of the current member; False at its end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = bytes(self.file.read(CHUNK))
        if not self.raw:
            self.held += self.inflate.flush()
            if not self.inflate.eof:
                raise EOFError("the archive ends inside a record")
            return True
        self.held += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def next_member(self) -> bool:
        """Start the next member; False at the end of the file."""
        if not self.raw:
            self.raw = bytes(self.file.read(CHUNK))
        if not self.raw:
            return False
        self.inflate, self.held = zlib.decompressobj(31), bytearray()
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                raise EOFError("a record without the end of its header")
        found = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return found

    def take(self, n: int):
        """The next n bytes, piece by piece."""
        while n:
            if not self.held and not self.fill():
                raise EOFError("a record shorter than its Content-Length")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(rf"<{RECORD_ID}(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def records(file, payloads: bool = False):
    """Rows of RECORDS from an open archive, in order."""
    stream = _Stream(file)
    while stream.next_member():
        fields = _fields(stream.until(b"\r\n\r\n"))
        whole, body, head, kept, http, n = hashlib.sha1(), hashlib.sha1(), b"", [], None, 0
        for piece in stream.take(int(fields["content-length"])):
            whole.update(piece)
            if http is None:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece = _fields(head[:at]), head[at + 4 :]
            body.update(piece)
            n += len(piece)
            if payloads:
                kept.append(piece)
        while stream.fill():
            pass
        if bytes(stream.held) != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        coded = lambda h: base64.b32encode(h.digest()).decode()
        said, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
        verified = coded(whole) == fields["warc-block-digest"].removeprefix("sha1:") and (revisit or coded(body) == said)
        size = int((http or {}).get("content-length", n)) if revisit else n
        yield (_page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _page(fields.get("warc-refers-to")), size, said if revisit else coded(body), verified, None if revisit or not payloads else b"".join(kept))


def read(files: DataFrame, payloads: bool = False, batch_records: int = 1000) -> DataFrame:
    """The records of archives listed in ``files`` (path); a record that fails its digests has ``verified`` false."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])

    def rows(batches):
        held = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as file:
                    for row in records(file, payloads):
                        held.append(row)
                        if len(held) >= batch_records:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    tasks = max(1, min(files.count(), 100_000))
    return files.select("path").repartition(tasks).mapInArrow(rows, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read them back: what the archives say of every page."""
    back = read(write(pages, **options))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
