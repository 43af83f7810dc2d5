"""WARC archives: one gzip member per record, written and read as streams.

Writing: each task appends records to archives of bounded size in a shared
folder. Every attempt of a task writes files of its own name; the list of
archives, itself stored as a table, names only those of the attempts that
succeeded. Of records with equal payloads of at least 1000 bytes the one with the
largest page_id is a response, the others are revisits that refer to it and
carry the HTTP head only.

Reading: an archive is read once from front to back. Each member is inflated
piece by piece, the record is framed by its content length, and the digests of
block and payload are worked out while the bytes pass and compared with the
header. No archive and no payload is held whole unless the payload is asked for.

Null html is an empty payload, a null url an empty one. A null page_id comes
before all others, and if all ids of a payload are null, all are responses.
Rows that repeat: every row that holds the largest page_id is a response.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.session import materialise, scratch_dir

runs_on_workers(__name__)

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": urllib.parse.quote(url or "", safe="/:?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": sha1_base32(payload),
        "WARC-Block-Digest": sha1_base32(block),
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(text.encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


class MemberReader:
    """Reads one gzip member after the other from an open stream."""

    def __init__(self, stream: object):
        self.stream, self.rest, self.inflate, self.ended = stream, b"", None, False

    def next_member(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        if not self.rest:
            return False
        self.inflate, self.ready, self.ended = zlib.decompressobj(31), b"", False
        return True

    def _more(self) -> bool:
        """Inflate one more piece of the member into ``ready``."""
        while not self.ended:
            data = self.inflate.unconsumed_tail or self.rest
            if not data:
                data = self.stream.read(READ_BYTES)
                if not data:
                    raise ValueError("the archive ends inside a record")
            self.rest = b""
            out = self.inflate.decompress(data, READ_BYTES)
            if self.inflate.eof:
                self.ended, self.rest = True, self.inflate.unused_data
            if out:
                self.ready += out
                return True
        return False

    def head(self) -> bytes:
        """Up to and without the next empty line."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("no end of a header")
        found, self.ready = self.ready[:at], self.ready[at + 4 :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("a record is shorter than its content length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> bytes:
        """What the member still holds."""
        while self._more():
            if len(self.ready) > READ_BYTES:
                raise ValueError("a record is longer than its content length")
        return self.ready


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(stream: object, keep_payload: bool = False) -> Iterator[dict]:
    """Every record of an archive in its order, verified."""
    reader = MemberReader(stream)
    while reader.next_member():
        warc = fields(reader.head())
        block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        http, pending = None, b""
        for piece in reader.pieces(int(warc["content-length"])):
            block.update(piece)
            if http is None:
                pending += piece
                at = pending.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, piece = fields(pending[:at]), pending[at + 4 :]
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        tail = reader.finish()
        revisit = warc["warc-type"] == "revisit"
        declared = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:"))
        whole = int((http or {}).get("content-length", -1))
        sound = tail == b"\r\n\r\n" and base64.b32decode(warc["warc-block-digest"].removeprefix("sha1:")) == block.digest()
        yield {
            "page_id": page_of(warc["warc-record-id"]),
            "url": urllib.parse.unquote(warc["warc-target-uri"]),
            "record_type": warc["warc-type"],
            "refers_to": page_of(warc.get("warc-refers-to")),
            "payload_bytes": whole if revisit else size,
            "payload_digest": declared.hex() if revisit else payload.hexdigest(),
            "verified": sound and (size == 0 if revisit else declared == payload.digest() and whole == size),
            **({"payload": None if revisit else b"".join(kept)} if keep_payload else {}),
        }


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, revisit, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # the digest is summed up map-side: a payload that a third of the pages share is one row per task
    digest = F.sha1("payload")
    long = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    shared = long.groupBy(digest.alias("__d")).agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = rows.join(shared, digest == F.col("__d"), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are
    left out). Returns the list of archives: path, records, bytes."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        out, path, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(root, recursive=True)
                    out, path, records, size = files.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                size += out.write(data := make_record(page_id, url, payload, refers_to, revisit)) or len(data)
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    listed = with_record_types(pages).mapInArrow(write, "path string, records long, bytes long")
    return materialise(listed, "archives")


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the listed archives: RECORDS, and payload if asked for."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = filesystem(uri)
                with files.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for record in read_records(stream, keep_payload):
                        rows.append(record)
                        held += len(record.get("payload") or b"")
                        if len(rows) >= 1000 or held > ARCHIVE_BYTES:
                            yield as_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows)

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        columns = {n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names}
        if keep_payload:
            columns["payload"] = pa.array([r["payload"] for r in rows], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(read, RECORDS + ", payload binary" * keep_payload)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back: one row per page with
    page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    return read_archives(write_archives(pages)).drop("url")
