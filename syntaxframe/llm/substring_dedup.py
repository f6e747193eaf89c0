"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash among its GRAM-word pieces, so
neighbouring windows mostly share one; a maximal run of windows with the same minimiser (a super-k-mer) travels as one
packed string to the minimiser's bucket. Inside a bucket the windows are sorted by hash, equal neighbours are compared
word for word, and every window whose words also start in a document with a smaller id is marked.

Heavy groups: (1) before anything travels, windows of a chunk of documents are sorted among themselves, and a window
that has a smaller document in its own chunk is marked there and not sent, so a passage costs one copy a chunk; (2) a
first pass counts minimisers (exactly those frequent in a chunk, the others by a thinned count, as it only steers the
dealing); those that lead more super-k-mers than HOT_SHARE of all, or than HOT_RUNS, are hot: they rank last, so that
windows prefer rarer pieces, and windows made only of hot pieces are spread by their own hash. At most MOST_HOT minimisers
are hot, so at any size a bucket holds BUCKET_BYTES of text and minimisers of at most the larger of HOT_RUNS runs (some 2 MB)
and a MOST_HOT-th of all runs (some 100 MB at 100 TB); (3) a passage found in every chunk still sends a copy a chunk to its
buckets: a task that has gathered COMPACT_BYTES marks the losers among them, drops runs all of whose windows lost, and goes
on, so that it holds each different window once, however many copies arrive.

Defined results for odd input: null or empty texts have no words; a null id counts as larger than every other; rows with
equal id and equal text get equal results; further columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import LAST_ID, written

WINDOW = 13
GRAM = 3
#: A minimiser is hot if it leads this share of all super-k-mers, or this many of them.
HOT_SHARE = 1 / 2000
HOT_RUNS = 1 << 14
#: Most minimisers that are hot; they are broadcast, eight bytes each.
MOST_HOT = 1 << 20
#: Super-k-mers of minimisers that are rare in their chunk are counted by one in THIN.
THIN = 64
#: Documents handled together before packing, in bytes.
PACK_BYTES = 3 << 20
#: Packs of a bucket that a task gathers before it drops what has lost, in bytes.
COMPACT_BYTES = 8 << 20
#: Text for each bucket, in bytes.
BUCKET_BYTES = 4 << 20

#: Bits of a text's hash, and the mark beside them of rows without an id.
KEY_BITS, NO_ID = 56, 1 << 62

_U = np.uint64
_HOT = _U(1 << 63)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SPAN = "k_id long, k_text long, start int, stop int"
_SPAN_ARROW = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_PACK_ARROW = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), *_SPAN_ARROW])


def row_keys(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell rows apart, for they travel with every run. Rows with an id: the id and KEY_BITS of the text's hash, as only rows that
    share an id need to be told apart by it. Rows without one: 64 more bits of the hash in place of the id, and a mark (NO_ID)."""
    raw, at = data.tobytes(), offsets.tolist()
    found = [xxhash.xxh3_128_intdigest(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
    keys = np.array([h & ((1 << KEY_BITS) - 1) for h in found], np.int64)
    none = ids == LAST_ID
    more = np.array([h >> 64 if n else 0 for h, n in zip(found, none.tolist())], np.uint64).view(np.int64)
    return np.where(none, more, ids), np.where(none, keys | NO_ID, keys)


def ranks(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The ids by which rows with these keys are compared."""
    return np.where(keys & NO_ID != 0, LAST_ID, ids)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Chunk:
    """Windows of a chunk of documents, with their minimisers."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray):
        self.words = tk.Words(data, offsets, tk.PLAIN_WORD)
        self.at = self.words.windows(WINDOW)
        hashes = self.words.hashes()
        self.hash = tk.rolled(hashes, WINDOW)[self.at]
        grams = tk.rolled(hashes, GRAM) >> _U(1)
        if len(hot) and len(grams):
            near = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
            grams = np.where(hot[near] == grams, grams | _HOT, grams)
        self.lead = _least(grams, WINDOW - GRAM + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.key = np.where(self.lead >= _HOT, self.hash, tk.mix(self.lead))
        self.row = np.searchsorted(self.words.first, self.at, side="right") - 1
        self.id = ids[self.row]

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 (in self.at) of maximal runs of chosen windows with one key in one document."""
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(chosen), bool)
        new[1:] = (self.at[chosen[1:]] != self.at[chosen[:-1]] + 1) | (self.key[chosen[1:]] != self.key[chosen[:-1]])
        new[1:] |= self.row[chosen[1:]] != self.row[chosen[:-1]]
        first = np.flatnonzero(new)
        return chosen[first], chosen[np.append(first[1:], len(chosen)) - 1] + 1


def beaten(hashes: np.ndarray, ids: np.ndarray, same: object) -> np.ndarray:
    """Which windows also start in a document with a smaller id. ``same(a, b)`` compares windows of equal hash by words."""
    order = np.lexsort((ids, hashes))
    ranked = hashes[order]
    head = np.ones(len(order), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    first = order[begin][group]  # the window with the smallest id of each group
    out = np.zeros(len(order), bool)
    loses = np.flatnonzero(ids[order] > ids[first])
    equal = same(order[loses], first[loses])
    out[order[loses[equal]]] = True
    if not equal.all():  # two word sequences with one hash: settle such groups by their words
        for g in np.unique(group[loses[~equal]]).tolist():
            members = order[begin[g] : begin[g + 1] if g + 1 < len(begin) else len(order)]
            for i in members.tolist():
                smaller = members[ids[members] < ids[i]]
                out[i] = len(smaller) > 0 and bool(same(np.full(len(smaller), i), smaller).any())
    return out


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray):
    """Comparison of windows, word for word, by their bytes."""
    raw = data.tobytes()

    def same(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        good = np.ones(len(left), bool)
        a, b = at[left], at[right]
        spans = [ends[x + WINDOW - 1] - starts[x] for x in (a, b)]
        for i in range(len(left)):
            p, q = starts[a[i]], starts[b[i]]
            x, y = raw[p : p + spans[0][i]], raw[q : q + spans[1][i]]
            good[i] = x == y or x.split() == y.split()
        return good

    return same


def _packs(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for ids, data, offsets in _texts(batches):
        chunk, (names_of, keys) = _Chunk(ids, data, offsets, hot), row_keys(ids, data, offsets)
        words = chunk.words
        lost = beaten(chunk.hash, chunk.id, _same_words(data, words.starts, words.ends, chunk.at))
        yield _spans(chunk, np.flatnonzero(lost), names_of, keys, buckets)
        first, stop = chunk.runs(np.flatnonzero(~lost))
        bucket = (chunk.key[first] % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, stop, bucket = first[order], stop[order], bucket[order]
        row = chunk.row[first]
        start_word, end_word = chunk.at[first], chunk.at[stop - 1] + WINDOW
        byte_from, byte_to = words.starts[start_word], words.ends[end_word - 1]
        heads = [names_of[row], keys[row], start_word - words.first[row], byte_to - byte_from]
        heads = [column.astype(kind) for column, kind in zip(heads, _HEAD)]
        raw, edge = data.tobytes(), np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        froms, tos = byte_from.tolist(), byte_to.tolist()
        names, blobs = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            body = b"".join([raw[froms[i] : tos[i]] for i in range(a, b)])
            blobs.append(squeeze.compress(b"".join([struct.pack("<i", b - a), *(h[a:b].tobytes() for h in heads), body])))
            names.append(int(bucket[a]))
        empty = [pa.nulls(len(names), f.type) for f in _SPAN_ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), *empty], schema=_PACK_ARROW)


#: Column types of a pack's heads: a row's two keys, word number of the start, bytes.
_HEAD = ("<i8", "<i8", "<i4", "<i4")


def _spans(chunk: _Chunk, lost: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marked windows of a chunk as merged word ranges; they pass through any bucket."""
    at, row = chunk.at[lost], chunk.row[lost]
    new = np.ones(len(lost), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(row) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lost)) - 1 if len(first) else first
    row, n = row[first], len(first)
    base = chunk.words.first[row]
    found = [ids[row], keys[row], (at[first] - base).astype(np.int32), (at[last] - base + WINDOW).astype(np.int32)]
    bucket = ((at[first] * 7 + (keys[row] & ~NO_ID)) % buckets).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(n, pa.binary()), *map(pa.array, found)], schema=_PACK_ARROW)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in tk.chunks(batch.column(1), PACK_BYTES):
            yield ids[row:end], data, offsets


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many super-k-mers of a chunk a minimiser leads; and, under -1, how many super-k-mers there are; under -2, bytes."""
    for ids, data, offsets in _texts(batches):
        chunk = _Chunk(ids, data, offsets, np.zeros(0, np.uint64))
        first, _ = chunk.runs(np.arange(len(chunk.at)))
        lead = chunk.lead[first]
        gram, inverse, n = np.unique(lead, return_inverse=True, return_counts=True)
        heavy = n >= max(2, len(first) * HOT_SHARE)
        # By place and document, so that copies of a passage are thinned one by one.
        place = chunk.at[first].astype(np.uint64) + tk.mix(chunk.id[first].astype(np.int64).view(np.uint64))
        thin = np.flatnonzero((tk.mix(place) % _U(THIN) == 0) & ~heavy[inverse])
        rare, times = np.unique(lead[thin], return_counts=True)
        grams = np.concatenate([gram[heavy].view(np.int64), rare.view(np.int64), [-1, -2]])
        counts = np.concatenate([n[heavy], times * THIN, [len(first), len(data)]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive one after the other; each is unpacked, its windows sorted, and the marked ones returned."""
    held: list[bytes] = []
    bucket, size, limit = None, 0, COMPACT_BYTES

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, limit
        if held:
            yield _marked(held)[0]
            held.clear()
        size, limit = 0, COMPACT_BYTES

    for batch in batches:
        done = batch.filter(pc.is_null(batch.column(1)))
        if done.num_rows:
            yield done.select(_SPAN_ARROW.names)
        for name, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if packed.is_valid:
                if name != bucket:
                    yield from flush()
                    bucket = name
                held.append(packed.as_py())
                size += len(held[-1])
                if size > limit:
                    spans, held[:] = _marked(held, keep=True)
                    yield spans
                    size = sum(map(len, held))
                    limit = max(COMPACT_BYTES, 2 * size)
    yield from flush()


def _packed(heads: list[np.ndarray], body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack("<i", len(heads[0])), *(h.tobytes() for h in heads), body]))


def _marked(packed: list[bytes], keep: bool = False) -> tuple[pa.RecordBatch, list[bytes]]:
    """Spans of the windows that lose among those packed; keep: and packs of the runs with a window that does not."""
    opener, heads, bodies = zstandard.ZstdDecompressor(), [[] for _ in _HEAD], []
    for blob in packed:
        raw = opener.decompress(blob)
        (n,), at = struct.unpack_from("<i", raw), 4
        for held, kind in zip(heads, _HEAD):
            held.append(np.frombuffer(raw, kind, n, at))
            at += held[-1].nbytes
        bodies.append(raw[at:])
    ids, keys, place, size = map(np.concatenate, heads)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    del bodies
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    words = tk.Words(data, offsets, tk.PLAIN_WORD)
    at = words.windows(WINDOW)
    run = np.searchsorted(words.first, at, side="right") - 1
    hashes = tk.rolled(words.hashes(), WINDOW)[at]
    loses = beaten(hashes, ranks(ids, keys)[run], _same_words(data, words.starts, words.ends, at))
    kept = []
    if keep:
        stays = np.unique(run[~loses])
        raw = data.tobytes()
        body = b"".join([raw[a:b] for a, b in zip(offsets[stays].tolist(), offsets[stays + 1].tolist())])
        if len(stays):
            kept.append(_packed([h[stays].astype(kind) for h, kind in zip((ids, keys, place, size), _HEAD)], body))
    lost = np.flatnonzero(loses)
    at, run = at[lost], run[lost]
    new = np.ones(len(lost), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(run) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lost)) - 1 if len(first) else first
    run = run[first]
    start = place[run] + (at[first] - words.first[run])
    stop = place[run] + (at[last] - words.first[run]) + WINDOW
    found = [ids[run], keys[run], start.astype(np.int32), stop.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_SPAN_ARROW), kept


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, start, stop): word ranges of docs(doc_id, text) whose windows start in a document with a smaller id."""
    counts = docs.mapInArrow(_hot_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "minimisers")
    sizes = dict(map(tuple, counts.where("gram < 0").collect()))
    total = sizes.get(-1, 0)
    # Each has over a MOST_HOT-th of all super-k-mers, so there are fewer than about MOST_HOT of them.
    bound = max(min(total * HOT_SHARE, HOT_RUNS), total / MOST_HOT)
    found = counts.where((F.col("gram") >= 0) & (F.col("n") > bound)).select("gram").toArrow()
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, sizes.get(-2, 0) // BUCKET_BYTES + 1)

    packs = docs.mapInArrow(lambda it: _packs(it, hot.value, buckets), "bucket int, packed binary, " + _SPAN)
    return packs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle, _SPAN)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, packed, spans in zip(*(batch.column(i) for i in range(3))):
            words = opener.decompress(packed.as_py()).split()
            gone = np.zeros(len(words) + 1, np.int64)
            for span in spans.as_py() or ():
                gone[span["start"]] += 1
                gone[span["stop"]] -= 1
            n = len(words)
            if spans.is_valid:
                keep = np.cumsum(gone)[:n] == 0
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            rows.append((doc_id.as_py(), n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), b" ".join(words).decode()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))] if rows else [pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: words, words removed, digest of the kept words and (``kept``) the kept text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Equal rows mark the same words, each for itself: of ranges with one start the longest holds the others, so a text has no more
    # ranges than words, however many rows have it.
    longest = repeated_spans(docs).groupBy("k_id", "k_text", "start").agg(F.max("stop").alias("stop"))
    spans = longest.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts travel to their spans compressed."""
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row, end, data, offsets in tk.chunks(batch.column(1)):
                part, raw, at = batch.slice(row, end - row), data.tobytes(), offsets.tolist()
                packed = [squeeze.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                ids, keys = row_keys(part.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False), data, offsets)
                columns = [part.column(0), pa.array(packed, pa.binary()), pa.array(ids), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "packed", "k_id", "k_text"])

    left = docs.mapInArrow(keyed, "doc_id long, packed binary, k_id long, k_text long")
    joined = left.join(spans, ["k_id", "k_text"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_apply, SCHEMA + ", kept string")
