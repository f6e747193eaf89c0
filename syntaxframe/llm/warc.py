"""WARC archives, and the monolithic gzip normaliser.

A monolithic archive is one gzip stream over many records, so no record can be read without inflating all before it. The
normaliser inflates such a stream once, in pieces, finds the records by their Content-Length, rewrites every record as a
gzip member of its own, and writes a sidecar index of member offsets (one JSON line a record, beside the archive). Memory
follows the largest record, never the archive.

Archives live in the shared folder. Each task attempt writes files of its own name, and only files named in the manifest of
successful tasks are read on, so lost executors and repeated tasks leave no half-written archive behind in the result.

Defined results for odd input: a null html is an empty payload; a null page id counts as larger than every other; of equal
payloads every row with the least id is a response; null URLs give a record without target; further columns are ignored; an
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import last_if_null, shared_dir, written

#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(_SPACE, f'page/{page_id}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(ch if " " < ch != "\x7f" else "".join(f"%{b:02X}" for b in ch.encode()) for ch in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) of the record at the head of raw, and where its block begins."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip file of any number of members, inflated piece by piece. Refused if its last member does not end."""
    engine = None
    for piece in pieces:
        while piece:
            if engine is None:
                piece = piece.lstrip(b"\0")  # padding between members
                if not piece:
                    break
                engine = zlib.decompressobj(31)
            data = engine.decompress(piece, READ_BYTES)
            if data:
                yield data
            if engine.eof:
                piece, engine = engine.unused_data, None
            else:
                piece = engine.unconsumed_tail
    while engine is not None:
        # What the last call held back. A whole member ends here, a cut one does not.
        data = engine.decompress(b"", READ_BYTES)
        if data:
            yield data
        if engine.eof:
            return
        if not data:
            raise ValueError("archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their Content-Length."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head, start = headers_of(bytes(held[: at + 4]))
                need = start + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError(f"archive ends inside a record, {len(held)} bytes left")


def members(source: Iterator[bytes], sink) -> Iterator[tuple[dict[str, str], int, int]]:
    """Rewrites each record of an inflated stream as one gzip member: (headers, offset, length) of each."""
    at = 0
    for raw in records(source):
        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = engine.compress(raw) + engine.flush()
        sink.write(packed)
        yield headers_of(raw)[0], at, len(packed)
        at += len(packed)


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(READ_BYTES):
        yield piece


def _task_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages(page_id, url, payload, refers_to, revisit), each one gzip stream; the manifest (path, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        sink, n, size, number, path = None, 0, 0, 0, ""

        def close():
            sink.write(engine.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c for c in batch.columns)):
                if sink is None:
                    name = f"mono-{_task_name()}-{number:04d}.warc.gz"
                    path, number, n, size = f"{folder}/{name}", number + 1, 0, 0
                    sink, engine = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (payload.as_py() or "").encode()
                sink.write(engine.compress(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), revisit.as_py())))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return written(pages.mapInArrow(write, "path string, n_records long"), "manifest")


_INDEX = "archive string, offset long, length long, record_id string, record_type string"


def _rewritten(name: str, pieces: Iterator[bytes], folder: str) -> pa.RecordBatch:
    """Normalises one archive into folder, with its sidecar; its index rows."""
    out, base = _open(folder)
    out.create_dir(base, recursive=True)
    name, rows = f"{name.removesuffix('.warc.gz')}-{_task_name()}.warc.gz", []
    with out.open_output_stream(f"{base}/{name}", compression=None) as sink:
        for head, offset, length in members(inflated(pieces), sink):
            rows.append((f"{folder}/{name}", offset, length, head.get("warc-record-id"), head.get("warc-type")))
    with out.open_output_stream(f"{base}/{name}.index.jsonl", compression=None) as sidecar:
        for _, offset, length, rid, kind in rows:
            sidecar.write((json.dumps({"offset": offset, "length": length, "id": rid, "type": kind}) + "\n").encode())
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(types)
    names = ["archive", "offset", "length", "record_id", "record_type"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def normalised(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives named in manifest(path) record by record; the index (archive, offset, length, ...)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = _open(path)
                with files.open_input_stream(inner, compression=None) as source:
                    yield _rewritten(inner.rsplit("/", 1)[1], _pieces(source), folder)

    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, manifest.count()))
    return written(manifest.select("path").repartition(parts, "path").mapInArrow(rewrite, _INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Reads each indexed member by its offset, checks its payload against its digest, and returns what it says."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != opened:
                    if source is not None:
                        source.close()
                    files, inner = _open(archive)
                    source, opened = files.open_input_file(inner), archive
                source.seek(offset)
                raw = zlib.decompress(source.read(length), 31)
                head, start = headers_of(raw)
                block = raw[start : start + int(head["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length:")[2])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"{archive} at {offset}: the payload is not what its digest says")
                page = int(head["x-page"]) if head["x-page"] else None
                rows.append((page, size, digest, head["warc-type"], int(head["x-refers-to-page"]) if revisit else None, archive, offset, length))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.nulls(0, t) for t in types], names=names)
        if source is not None:
            source.close()

    archives = index.select("archive").distinct().count()
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, archives))
    rows = index.select("archive", "offset", "length").repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(read, SCHEMA)


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to and revisit: all but the least id of equal payloads revisit it."""
    payload = F.coalesce("html", F.lit(""))
    key = [F.sha1(payload).alias("sha1"), F.xxhash64(payload).alias("xx"), F.octet_length(payload).alias("size")]
    known = pages.select(last_if_null(F.col("page_id")).alias("k"), *key).where(F.col("size") >= least_bytes)
    groups = known.groupBy("sha1", "xx", "size").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    groups = written(groups.drop("last"), "equal-payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = pages.select("page_id", "url", payload.alias("payload"), *key).join(groups, ["sha1", "xx", "size"], "left")
    revisit = F.coalesce(F.col("first") < last_if_null(F.col("page_id")), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to monolithic archives, normalises them, reads the records back by their index."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_monolithic(decided(pages, least_bytes), folder)
    return read_records(normalised(manifest, folder))


def normalise_files(archives: DataFrame, folder: str) -> DataFrame:
    """The normaliser for archives that Spark lists (rows with a path, such as those of its binaryFile source, whose content is
    not read): each is opened as a stream, so it may have any size."""
    plain = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    return normalised(archives.select(plain.alias("path")), folder)
