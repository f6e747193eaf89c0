"""A data source of documents: ``spark.read.format("documents").load(folder)``.

Rows are (doc_id, path, member, kind, size, text): a row for each file, and for each member of a zip archive. Small files and members are packed
into partitions of about ``partitionBytes``; an archive is split by its members, each read by itself, so that one large archive is
many tasks. Conditions on path, kind and member are tried on the listing (with spark.sql.python.filterPushdown.enabled), before any
content is read; the text is read only where the columns asked for have it.

As a stream (``spark.readStream.format("documents")``) new files are read as they come, by their time of change and path. A file that is put in
place with an older time than the last one that was read is not seen.

The folder may be any that pyarrow's file systems know (file, hdfs, s3, ...). The listing is the driver's: some hundred bytes a file, as with
Spark's own file sources.

Defined results: bytes that are not of the ``encoding`` (UTF-8 by default) become U+FFFD; names that begin with a dot or underscore are left out; an
empty folder gives no rows; a missing one an error.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "doc_id string, path string, member string, kind string, size long, text string"
PARTITION_BYTES = 64 << 20
#: What opening a file counts for when files are packed.
OPEN_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

_TYPES = {"doc_id": pa.string(), "path": pa.string(), "member": pa.string(), "kind": pa.string(), "size": pa.int64(), "text": pa.string()}


@dataclass(frozen=True)
class Entry:
    """A document in the listing."""

    path: str
    member: str | None
    size: int
    changed: int

    @property
    def kind(self) -> str:
        name = (self.member or self.path).rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[1].lower() if "." in name else ""

    @property
    def doc_id(self) -> str:
        return self.path if self.member is None else f"{self.path}!{self.member}"


@dataclass
class Packed(InputPartition):
    """Documents of one partition, those of an archive beside each other."""

    entries: list[Entry]

    def __init__(self, entries: list[Entry]):
        self.entries = entries


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(root: str, after: tuple[int, str] | None = None, until: tuple[int, str] | None = None) -> list[Entry]:
    """All documents below a folder (or the one file), those of archives by their directories; after, until: only files changed between
    these times (and paths, where the time is the same)."""
    from pyarrow import fs

    files, base = _system(root)
    top = files.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    infos = [top] if top.type == fs.FileType.File else files.get_file_info(fs.FileSelector(base, recursive=True))
    out = []
    for info in sorted(infos, key=lambda i: i.path):
        inner = info.path[len(base) :] if info is not top else ""
        if info.type != fs.FileType.File or any(p[:1] in "._" for p in inner.split("/") if p):
            continue
        place = info.mtime_ns or 0, info.path
        if after is not None and place <= after or until is not None and place > until:
            continue
        if info.path.lower().endswith(".zip"):
            with files.open_input_file(info.path) as raw, zipfile.ZipFile(raw) as archive:
                out += [Entry(info.path, m.filename, m.file_size, place[0]) for m in archive.infolist() if not m.is_dir()]
        else:
            out.append(Entry(info.path, None, info.size or 0, place[0]))
    return out


def packed(entries: list[Entry], most: int) -> list[Packed]:
    """Partitions of about so many bytes, in the order of the listing."""
    out: list[list[Entry]] = []
    held = 0
    for e in entries:
        beside = out and e.member is not None and out[-1][-1].path == e.path
        if not out or held + e.size + (0 if beside else OPEN_BYTES) > most:
            out.append([])
            held, beside = 0, False
        out[-1].append(e)
        held += e.size + (0 if beside else OPEN_BYTES)
    return [Packed(x) for x in out]


def _contents(files, entries: list[Entry]) -> Iterator[tuple[Entry, bytes]]:
    raw = archive = None
    for e in entries:
        if e.member is None:
            with files.open_input_stream(e.path, compression=None) as source:
                yield e, source.read()
            continue
        if archive is None or raw[0] != e.path:
            raw = e.path, files.open_input_file(e.path)
            archive = zipfile.ZipFile(raw[1])
        yield e, archive.read(e.member)


def rows_of(root: str, entries: list[Entry], columns: list[str], encoding: str) -> Iterator[pa.RecordBatch]:
    """The columns asked for; contents are read only for the text."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(columns, list(zip(*rows)) or [()] * len(columns))], names=columns)

    files, rows, held = _system(root)[0], [], 0
    for e, content in _contents(files, entries) if "text" in columns else ((e, b"") for e in entries):
        known = {"doc_id": e.doc_id, "path": e.path, "member": e.member, "kind": e.kind, "size": e.size}
        rows.append(tuple(io.TextIOWrapper(io.BytesIO(content), encoding, "replace", newline="").read() if n == "text" else known[n] for n in columns))
        held += len(content) + 100
        if held >= BATCH_BYTES:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


class _Options:
    def __init__(self, source: DataSource):
        options = source.options
        if not options.get("path"):
            raise ValueError("documents need a path")
        self.root, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))


class DocumentReader(DataSourceReader):
    def __init__(self, options: _Options, columns: list[str]):
        self.options, self.columns, self.tests = options, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Those on what the listing knows are taken; all others go back."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if len(name) == 1 and name[0] in ("path", "kind", "member", "doc_id") and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((type(f).__name__, name[0], value))
            else:
                yield f

    def _fits(self, e: Entry) -> bool:
        said = {
            "EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "StringStartsWith": lambda x, v: x.startswith(v), "StringEndsWith": lambda x, v: x.endswith(v),
            "StringContains": lambda x, v: v in x,
        }
        return all((x := getattr(e, name)) is not None and said[test](x, value) for test, name, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        return packed([e for e in listing(self.options.root) if self._fits(e)], self.options.most)

    def read(self, partition: Packed | None) -> Iterator[pa.RecordBatch]:
        return rows_of(self.options.root, partition.entries if partition else [], self.columns, self.options.encoding)


class DocumentStreamReader(DataSourceStreamReader):
    """Offsets are (time of change, path) of the last file that was read."""

    def __init__(self, options: _Options, columns: list[str]):
        self.options, self.columns = options, columns

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        found = [(e.changed, e.path) for e in listing(self.options.root)]
        return {"at": json.dumps(list(max(found, default=(-1, ""))))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = (tuple(json.loads(x["at"])) for x in (start, end))
        return packed(listing(self.options.root, after, until), self.options.most)

    def read(self, partition: Packed | None) -> Iterator[pa.RecordBatch]:
        return rows_of(self.options.root, partition.entries if partition else [], self.columns, self.options.encoding)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(_Options(self), schema.fieldNames())

    def streamReader(self, schema) -> DocumentStreamReader:
        return DocumentStreamReader(_Options(self), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with conditions on the listing pushed down."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
