"""Token ids of all documents in binary shards, with keyed access through a minimal perfect hash index.

Shards. Documents are range-partitioned and sorted by id (then by a hash of the text), encoded in that order, and written as raw
little-endian ids: MAGIC, version and width (2 or 4 bytes an id), the ids of one document after the other, each with its end id, then
n + 1 eight-byte starts of the documents, counted in ids, and n. The manifest has a row for each shard with the number of ids
before it.

Index. A key is the id as text, hashed to 128 bits; 64 of them choose a bucket, and each bucket is a file of its own with a minimal
perfect hash of its keys: level by level, keys that are alone in their place of a bit array are settled, the others go to the
next level; the rank of a key's bit is its slot. A slot holds a fingerprint of the key, the shard, the document's number in it and
how many documents have the key (they are neighbours, and may run on into the next shards). So a lookup takes a fixed number of
steps, at any size, and a key that is not there is recognised by its fingerprint (but for one in four billion).

Heavy groups: equal ids are spread over partitions by the range partitioning (a running number is its last column), counted by
partial aggregation, take one slot, and are read back shard by shard.

Lost executors: a task attempt writes files of its own name; only those that successful attempts name are read.

Defined results for odd input: a null text is empty (the end id alone); a null id is a key of its own and comes after all others; rows
with equal ids follow each other by the hash of their text; equal rows get equal digests, one start each; an empty table gives an empty
store and an empty result; further columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import shared_dir

MAGIC, END = b"TOKSHARD", b"TOKSHEND"
VERSION = 1
#: Bytes of ids after which a task begins a new shard.
SHARD_BYTES = 256 << 20
#: Keys for each bucket of the index.
BUCKET_KEYS = 1 << 18
#: Bytes that a worker remembers, of words and of pieces with their ids; and what an entry takes besides its key.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Text that is encoded together, in bytes.
CHUNK_BYTES = 2 << 20
#: Words that are encoded as one text.
JOINED = 4096
#: Bits of a level for each key that reaches it.
GAMMA = 1.5
#: Rows, and ids of rows, that are returned together.
READ_ROWS, READ_IDS = 8192, 1 << 20
#: Shards whose totals are summed in one step.
SHARDS_A_STEP = 4096

_U = np.uint64
_ENTRY = "shard long, row long, doc_id long, n_tokens long, path string"
_ENTRY_ARROW = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string())])
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_SALT = "second"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _file_name(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


# ---- encoding


class Encoder:
    """Texts to ids as bytes. Where a tokenizer treats white space as a border and nothing else (which is tried out), words are encoded
    once and remembered; where its definition also says how words are cut into pieces that are encoded each by itself, so are the
    pieces. Words with ODD characters are always given to the library whole."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.engine = Tokenizer.from_str(definition)
        size = self.engine.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.by_word = self._borders()
        told = json.loads(definition)
        self.added = [t["content"] for t in told.get("added_tokens") or ()]
        self.added_bytes = [t.encode() for t in self.added]
        self.pieces_of = _piece_rule(told) if self.by_word else None
        #: Does an id end a piece?
        self.ends = np.array([(self.engine.id_to_token(i) or "").endswith(told["model"]["end_of_word_suffix"]) for i in range(size)]) if self.pieces_of else None
        self.words, self.pieces = _Remembered(), _Remembered()

    def _ids(self, text: str) -> list[int]:
        return self.engine.encode(text, add_special_tokens=False).ids

    def _borders(self) -> bool:
        words = ["Border", "it's", "12", "a.", "é", "-"]
        alone = [self._ids(w) for w in words]
        spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n\t "]
        return all(self._ids(f"{s}{a}{s}{b}{s}") == x + y for s in spaces for a, x in zip(words, alone) for b, y in zip(words, alone))

    def _learn_whole(self, words: list[str]) -> list[bytes]:
        """Many words as one text; a token belongs to the word in which it begins."""
        out: list[bytes] = []
        for k in range(0, len(words), JOINED):
            group = words[k : k + JOINED]
            one = self.engine.encode(" ".join(group), add_special_tokens=False)
            ids = np.array(one.ids, self.kind).tobytes()
            begins = np.array([a for a, _ in one.offsets], np.int64)
            size = np.fromiter(map(len, group), np.int64, len(group)) + 1
            edges = (np.searchsorted(begins, np.concatenate([[0], np.cumsum(size)])) * self.kind.itemsize).tolist()
            out += [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
        return out

    def _learn_pieces(self, pieces: list[str]) -> None:
        """ASCII is the same as bytes, so the model can be asked at once; of the others many are one text, and each ends with an id that ends a
        piece."""
        of, form = self.engine.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        self.pieces.add({p: array(form, [t.id for t in of(p)]).tobytes() for p in pieces if p.isascii()})
        pieces = [p for p in pieces if not p.isascii()]
        for k in range(0, len(pieces), JOINED):
            group = pieces[k : k + JOINED]
            found = np.array(self.engine.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != len(group):
                raise ValueError("the tokenizer's pieces do not end as its definition says")
            ids, edges = found.tobytes(), (ends * self.kind.itemsize).tolist()
            self.pieces.add(dict(zip(group, [ids[a:b] for a, b in zip([0, *edges[:-1]], edges)])))

    def _by_piece(self, words: list[str]) -> list[bytes]:
        """All words as one text of lines; the line ends stay between the pieces and stand for an id that no token has."""
        mark = np.array([np.iinfo(self.kind).max], self.kind)
        found = self.pieces_of("\n".join(words).lower())
        known = self.pieces.holding(set(found) - {"\n"}, self._learn_pieces)
        known["\n"] = mark.tobytes()
        ids = np.frombuffer(b"".join(map(known.__getitem__, found)), self.kind)
        at = np.flatnonzero(ids == mark)
        raw, edges = ids.tobytes(), (np.stack([np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])]) * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(*edges)]

    def _learn(self, new: list[bytes]) -> None:
        words = b"\n".join(new).decode().split("\n")
        whole = set(range(len(words)))
        if self.pieces_of:
            text = "\n".join(words)
            begins = np.cumsum([0, *map(len, words[:-1])]) + np.arange(len(words))
            odd = [m.start() for m in ODD(text)] + [m.start() for t in self.added for m in regex.finditer(regex.escape(t), text)]
            whole = set((np.searchsorted(begins, odd, side="right") - 1).tolist())
        if len(whole) < len(words):
            plain = [k for k in range(len(words)) if k not in whole] if whole else range(len(words))
            self.words.add(dict(zip([new[k] for k in plain], self._by_piece([words[k] for k in plain]))))
        rest = sorted(whole)
        self.words.add(dict(zip([new[k] for k in rest], self._learn_whole([words[k] for k in rest]))))

    def _lowered(self, text: bytes) -> bytes:
        """A-Z in lower case, as the tokenizer does anyway, unless that would make an added token."""
        low = text.lower()
        return low if all(t not in low or low.count(t) == text.count(t) for t in self.added_bytes) else text

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(self._ids(t.decode()), self.kind).tobytes() for t in texts]
        split = [self._lowered(t).split() for t in texts] if self.pieces_of else [t.split() for t in texts]
        ids = self.words.holding(set().union(*split), self._learn).__getitem__
        return [b"".join(map(ids, words)) for words in split]


class _Remembered:
    """What words or pieces became, in two generations: when the young one is full, the old one is forgotten."""

    def __init__(self):
        self.young: dict[Any, bytes] = {}
        self.old: dict[Any, bytes] = {}
        self.size = 0

    def add(self, found: dict[Any, bytes]) -> None:
        self.young.update(found)
        self.size += sum(map(len, found)) + ENTRY_BYTES * len(found)

    def holding(self, asked: set, learn: Callable[[list], None]) -> dict[Any, bytes]:
        """The young generation, with all that is asked for."""
        if self.size > CACHE_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        new = asked - self.young.keys()
        known = new & self.old.keys()
        self.add({w: self.old[w] for w in known})
        if len(new) > len(known):
            learn(list(new - known))
        return self.young


def _piece_rule(told: dict) -> Callable[[str], list[str]] | None:
    """How the definition of a tokenizer cuts words (after lower case) into pieces, if it is of the kind that says so: NFC, white space, lower
    case, one pattern for pieces, bytes, byte pairs with a mark at the end of a piece."""
    norm, pre, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told["model"]
    steps, cuts = norm.get("normalizers") or [], pre.get("pretokenizers") or []
    if [n["type"] for n in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or [p["type"] for p in cuts] != ["Split", "ByteLevel"]:
        return None
    pattern = cuts[0]["pattern"].get("Regex")
    if pattern is None or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
        return None
    return regex.compile(rf"(?:{pattern})|\n").findall


#: Characters in words that are left to the library. It and this language see the same letters, digits and cases in the others: the
#: printable ones below U+0250.
ODD = regex.compile(r"[^\n\x21-\x7E\xA1-\xAC\xAE-\u024F]").finditer


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = xxhash.xxh64_intdigest(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


# ---- shards


class _Shard:
    """A shard that is being written."""

    def __init__(self, folder: str, number: int, kind: np.dtype):
        self.number, self.starts, self.kind = number, [0], kind
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        name = _file_name("ids")
        self.path, self.sink = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None)
        self.sink.write(MAGIC + struct.pack("<II", VERSION, kind.itemsize))

    def add(self, payloads: list[bytes]) -> None:
        self.sink.write(b"".join(payloads))
        sizes = np.fromiter(map(len, payloads), np.int64, len(payloads)) // self.kind.itemsize
        self.starts += (self.starts[-1] + np.cumsum(sizes)).tolist()

    def close(self) -> tuple:
        n = len(self.starts) - 1
        self.sink.write(np.array(self.starts, "<u8").tobytes() + struct.pack("<Q", n) + END)
        self.sink.close()
        return self.number, -n - 1, None, self.starts[-1], self.path


def opened_shard(path: str) -> tuple[object, np.dtype, np.ndarray]:
    """(file, type of an id, starts of its documents) of a shard."""
    files, inner = _open(path)
    source = files.open_input_file(inner)
    magic, version, width = struct.unpack("<8sII", source.read(16))
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"{path} is not a token shard")
    size = source.size()
    source.seek(size - 16)
    n, end = struct.unpack("<Q8s", source.read(16))
    if end != END:
        raise ValueError(f"{path} is cut off")
    source.seek(size - 16 - 8 * (n + 1))
    return source, np.dtype(f"<u{width}"), np.frombuffer(source.read(8 * (n + 1)), "<u8").astype(np.int64)


def _write_shards(docs: DataFrame, folder: str, definition: str, end_id: int, shard_bytes: int) -> DataFrame:
    """Entries: a row for each document (shard, row, doc_id, n_tokens), and one for each shard (path, row = -1 - documents)."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, part = _encoder(shared.value), None, TaskContext.get().partitionId()
        end, k = np.array([end_id], encoder.kind).tobytes(), 0
        for batch in batches:
            for row, stop, data, offsets in tk.chunks(batch.column(1), CHUNK_BYTES):
                if shard is None:
                    shard, k = _Shard(folder, (part << 20) + k, encoder.kind), k + 1
                raw, at = data.tobytes(), offsets.tolist()
                first = len(shard.starts) - 1
                shard.add([ids + end for ids in encoder.encoded([raw[a:b] for a, b in zip(at[:-1], at[1:])])])
                n = stop - row
                sizes = np.diff(shard.starts[first : first + n + 1])
                columns = [pa.array(np.full(n, shard.number)), pa.array(np.arange(first, first + n)), batch.column(0).slice(row, n), pa.array(sizes), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ENTRY_ARROW)
                if shard.starts[-1] * encoder.kind.itemsize >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(shard.close(), _ENTRY_ARROW)], schema=_ENTRY_ARROW)
                    shard = None
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(shard.close(), _ENTRY_ARROW)], schema=_ENTRY_ARROW)

    order = ["no_id", "doc_id", "h", "nr"]
    ranged = docs.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nr"), "text")
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInArrow(write, _ENTRY)


def _manifest(entries: DataFrame) -> DataFrame:
    """(shard, path, n_docs, n_tokens, first_token) of each shard; running totals in two steps, of SHARDS_A_STEP shards each."""
    shards = entries.where("path is not null").select("shard", "path", (-F.col("row") - 1).alias("n_docs"), "n_tokens")
    shards = shards.withColumn("step", F.expr(f"(shard >> 20) div {SHARDS_A_STEP}"))
    before = F.sum("n_tokens").over(Window.partitionBy("step").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    steps = shards.groupBy("step").agg(F.sum("n_tokens").alias("of_step"))
    base = F.sum("of_step").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select("step", F.coalesce(base, F.lit(0)).alias("base"))
    shards = shards.withColumn("before", F.coalesce(before, F.lit(0))).join(steps, "step")
    return shards.select("shard", "path", "n_docs", "n_tokens", (F.col("base") + F.col("before")).alias("first_token"))


# ---- minimal perfect hash


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, as two columns."""
    text = key.cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit(_SALT), text)


def key_hash(key: object) -> tuple[int, int]:
    """The same for one key: signed 64-bit values."""
    raw = None if key is None else str(key).encode()
    seed = xxhash.xxh64_intdigest(_SALT, 42)
    found = [s if raw is None else xxhash.xxh64_intdigest(raw, s) for s in (42, seed)]
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in found)


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return tk.mix(h1 + tk.mix(h2 + _U(level))) % _U(bits)


class PerfectHash:
    """Slots 0 to n - 1 for n different keys of 128 bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        total = np.cumsum(np.concatenate([[0], *ones]))
        edges = np.cumsum([0, *map(len, levels)])
        #: Bits set before each word, over all levels.
        self.ranks = [total[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.n = int(total[-1])

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            if len(levels) > 200:
                raise ValueError("keys with equal hashes")
            words = int(len(h1) * GAMMA) // 64 + 1
            at = _place(h1, h2, len(levels), 64 * words).astype(np.int64)
            times = np.bincount(at, minlength=64 * words)
            alone = times == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it (then it is none of the n)."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = _place(h1[open_], h2[open_], k, 64 * len(bits))
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (bits[word] >> bit) & _U(1) == 1
            below = bits[word] & ((_U(1) << bit) - _U(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def tobytes(self) -> bytes:
        return struct.pack(f"<{len(self.levels) + 1}Q", len(self.levels), *map(len, self.levels)) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def read(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash at the head of raw, and where it ends."""
        (n,) = struct.unpack_from("<Q", raw)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", raw, 8), 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        return cls(levels), at


_SLOT = (("fingerprint", "<u4"), ("shard", "<i8"), ("row", "<i8"), ("copies", "<i8"))


class Bucket:
    """A bucket of the index: the perfect hash, and the columns of its slots."""

    def __init__(self, raw: bytes):
        self.hash, at = PerfectHash.read(raw)
        for name, kind in _SLOT:
            setattr(self, name, np.frombuffer(raw, kind, self.hash.n, at))
            at += self.hash.n * np.dtype(kind).itemsize

    @staticmethod
    def tobytes(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, row: np.ndarray, copies: np.ndarray) -> bytes:
        perfect = PerfectHash.of(h1, h2)
        slot, out = perfect.slots(h1, h2), [perfect.tobytes()]
        for (_, kind), values in zip(_SLOT, (h2 >> _U(32), shard, row, copies)):
            column = np.empty(len(h1), kind)
            column[slot] = values
            out.append(column.tobytes())
        return b"".join(out)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are there, their slots)."""
        if not self.hash.n:
            return np.zeros(len(h1), bool), np.zeros(0, np.int64)
        slot = self.hash.slots(h1, h2)
        there = (slot >= 0) & (self.fingerprint[slot] == (h2 >> _U(32)).astype(np.uint32))
        return there, slot[there]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows sorted by their first column, bucket by bucket: (bucket, the other columns)."""
    held, name = [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = np.flatnonzero(np.diff(columns[0])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(columns[0])]):
            if a == b:
                continue
            if columns[0][a] != name:
                if held:
                    yield name, list(map(np.concatenate, zip(*held)))
                held, name = [], int(columns[0][a])
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield name, list(map(np.concatenate, zip(*held)))


def _write_index(keys: DataFrame, folder: str) -> DataFrame:
    """Writes the bucket files of keys(bucket, h1, h2, shard, row, copies); (bucket, path, n_keys)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        for bucket, (h1, h2, shard, row, copies) in _by_bucket(batches):
            name = _file_name(f"index-{bucket:06d}")
            with files.open_output_stream(f"{base}/{name}", compression=None) as sink:
                sink.write(Bucket.tobytes(h1.view(np.uint64), h2.view(np.uint64), shard, row, copies))
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([f"{folder}/{name}"]), pa.array([len(h1)])], names=["bucket", "path", "n_keys"])

    return keys.mapInArrow(write, "bucket long, path string, n_keys long")


# ---- the store


@dataclass(frozen=True)
class TokenStore:
    """A store in a folder: shards, manifest, index files and their list."""

    spark: SparkSession
    folder: str
    buckets: int

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> TokenStore:
        """Encodes docs with the tokenizer file of the tokenizers library (read by the driver, sent to the workers) and writes the store."""
        spark = docs.sparkSession
        folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
        with open(tokenizer, encoding="utf-8") as file:
            definition = file.read()
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        _write_shards(docs, folder, definition, end_id, shard_bytes).write.option("compression", "zstd").parquet(f"{folder}/entries")
        entries = spark.read.schema(_ENTRY).parquet(f"{folder}/entries")
        _manifest(entries).write.parquet(f"{folder}/manifest")

        h1, h2 = key_hashes(F.col("doc_id"))
        keys = entries.where("path is null").groupBy("doc_id").agg(F.min(F.struct("shard", "row")).alias("at"), F.count("*").alias("copies"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Rows are at least as many as keys.
        rows = spark.read.parquet(f"{folder}/manifest").agg(F.sum("n_docs")).first()[0] or 0
        buckets = max(parts, rows // BUCKET_KEYS + 1)
        keys = keys.select(F.pmod(h1, F.lit(buckets)).alias("bucket"), h1.alias("h1"), h2.alias("h2"), "at.shard", "at.row", "copies")
        listed = _write_index(keys.repartition(buckets, "bucket").sortWithinPartitions("bucket"), folder)
        listed.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")
        return cls(spark, folder, buckets)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenStore:
        first = spark.read.parquet(f"{folder}/index").select("buckets").first()
        return cls(spark, folder, first[0] if first else 1)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("shard long, path string, n_docs long, n_tokens long, first_token long").parquet(f"{self.folder}/manifest")

    def _index(self) -> DataFrame:
        return self.spark.read.schema("bucket long, path string, n_keys long, buckets int").parquet(f"{self.folder}/index")

    def located(self, keys: DataFrame) -> DataFrame:
        """keys(doc_id) that the index has, each looked up there: (doc_id, shard, row, copies)."""
        h1, h2 = key_hashes(F.col("doc_id"))
        asked = keys.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.pmod(h1, F.lit(self.buckets)).alias("bucket"))
        asked = asked.join(self._index().select("bucket", "path"), "bucket").select("bucket", "path", "doc_id", "h1", "h2")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, bucket = None, None
            for batch in batches:
                paths = batch.column(1).to_numpy(zero_copy_only=False)
                edges = (np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist() if len(paths) else []
                for a, b in zip([0, *edges], [*edges, len(paths)]):
                    if a == b:
                        continue
                    if paths[a] != path:
                        path = paths[a]
                        files, inner = _open(path)
                        with files.open_input_stream(inner, compression=None) as source:
                            bucket = Bucket(source.read())
                    h1, h2 = (batch.column(k).slice(a, b - a).to_numpy().view(np.uint64) for k in (3, 4))
                    there, slot = bucket.find(h1, h2)
                    found = [batch.column(2).slice(a, b - a).filter(pa.array(there)), *(pa.array(x[slot]) for x in (bucket.shard, bucket.row, bucket.copies))]
                    yield pa.RecordBatch.from_arrays(found, names=["doc_id", "shard", "row", "copies"])

        asked = asked.repartition(self.buckets, "bucket").sortWithinPartitions("bucket")
        return asked.mapInArrow(look, "doc_id long, shard long, row long, copies long")

    def _pieces(self, located: DataFrame) -> DataFrame:
        """Runs of documents with one key, cut at shards' ends: (shard, path, first_token, row, n, doc_id). A row for each shard goes to all
        tasks: 16 bytes for some 256 MB of ids."""
        shards = self.manifest().select("shard", "n_docs").toArrow().sort_by("shard")
        names, ends = shards["shard"].to_numpy(), np.cumsum(shards["n_docs"].to_numpy())
        known = self.spark.sparkContext.broadcast((names, ends))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ends = known.value
            for batch in batches:
                shard, row, copies = (batch.column(k).to_numpy() for k in (1, 2, 3))
                number = np.searchsorted(names, shard)
                begin = ends[number] - shards_of(number) + row
                last = np.searchsorted(ends, begin + copies - 1, side="right")
                times = last - number + 1
                source = np.repeat(np.arange(len(shard)), times)
                each = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times) + number[source]
                low, high = ends[each] - shards_of(each), ends[each]
                a, b = np.maximum(begin[source], low), np.minimum((begin + copies)[source], high)
                columns = [pa.array(names[each]), pa.array(a - low), pa.array(b - a), batch.column(0).take(pa.array(source))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "row", "n", "doc_id"])

        def shards_of(number: np.ndarray) -> np.ndarray:
            ends = known.value[1]
            return ends[number] - np.where(number > 0, ends[number - 1], 0)

        return located.mapInArrow(cut, "shard long, row long, n long, doc_id long").join(self.manifest().select("shard", "path", "first_token"), "shard")

    def read(self, keys: DataFrame, ids: bool = False) -> DataFrame:
        """The documents that have one of the different keys(doc_id), from the files: doc_id, start (ids of all documents before it), n_tokens,
        ids_crc32 (of its ids as little-endian 32-bit integers) and, if asked for, the ids. Keys go through the index; each shard is
        then read in order, once."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path = source = None
            for batch in batches:
                rows, held = [], 0
                for place, first, row, n, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                    if place != path:
                        if source is not None:
                            source.close()
                        path, (source, kind, starts) = place, opened_shard(place)
                    for a, b in zip(starts[row : row + n].tolist(), starts[row + 1 : row + n + 1].tolist()):
                        source.seek(16 + a * kind.itemsize)
                        found = np.frombuffer(source.read((b - a) * kind.itemsize), kind).astype("<u4")
                        rows.append((doc_id, first + a, b - a, zlib.crc32(found), *([found.astype(np.int32)] if ids else ())))
                        held += (b - a) * ids
                        if held >= READ_IDS or len(rows) >= READ_ROWS:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)
            if source is not None:
                source.close()

        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pieces = self._pieces(self.located(keys)).select("path", "first_token", "row", "n", "doc_id")
        pieces = pieces.repartition(max(parts, min(1 << 16, self.manifest().count())), "path").sortWithinPartitions("path", "row")
        return pieces.mapInArrow(read, DIGEST + (", ids array<int>" if ids else ""))

    def get(self, key: object) -> list[np.ndarray]:
        """The ids of each document with this key, by one lookup and one read for each of them; none if the key is not there."""
        h1, h2 = (np.array([x], np.int64).view(np.uint64) for x in key_hash(key))
        listed = self._index().where(F.col("bucket") == int(h1.view(np.int64)[0]) % self.buckets).select("path").first()
        if listed is None:
            return []
        files, inner = _open(listed[0])
        with files.open_input_stream(inner, compression=None) as source:
            bucket = Bucket(source.read())
        there, slot = bucket.find(h1, h2)
        if not there[0]:
            return []
        shard, row, copies, out = int(bucket.shard[slot[0]]), int(bucket.row[slot[0]]), int(bucket.copies[slot[0]]), []
        while copies:
            place = self.manifest().where(F.col("shard") >= shard).orderBy("shard").select("shard", "path").first()
            source, kind, starts = opened_shard(place[1])
            with source:
                for k in range(row, min(row + copies, len(starts) - 1)):
                    source.seek(16 + int(starts[k]) * kind.itemsize)
                    out.append(np.frombuffer(source.read(int(starts[k + 1] - starts[k]) * kind.itemsize), kind))
                    copies -= 1
            shard, row = place[0] + 1, 0
        return out


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to a store and reads every one of them back by its key."""
    store = TokenStore.write(docs, tokenizer, end_id, id_col=id_col, text_col=text_col)
    return store.read(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct())
