"""Benchmark decontamination with an FM-index for each training shard.

A shard is a chunk of documents. Its words become integers: the benchmark's own words keep theirs, every other word is a
break, and runs of benchmark words too short to hold any test phrase are left out (no phrase can occur there). Over
what remains stands an FM-index: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, and every SAMPLE-th
suffix position. All test phrases are searched backwards at once; occurrences are located by walking to sampled
positions and checked byte for byte; overlapping occurrences are merged into removal spans.

Defined results for odd input: null texts and items have no words; an item without words is no item; equal item ids
count once; ids may be null or repeated (each document row is judged on its own; null item ids are left out of the list);
further columns are kept or ignored; empty tables give zero hits. The benchmark is held in blocks of at most BLOCK_BYTES of text,
each a broadcast. Where there are several, a worker opens one after the other for every GROUP_BYTES of documents and lets go
of each before the next, so the benchmark may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW = 13
#: Suffix positions kept: one in SAMPLE.
SAMPLE = 8
#: Most benchmark text in one block.
BLOCK_BYTES = 8 << 20
#: Documents judged together, in bytes, if the benchmark has several blocks.
GROUP_BYTES = 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())]
)


class Wavelet:
    """Rank over integer symbols: one bit plane for each bit, most significant first, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            total = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(ones, out=total[1:])
            self.planes.append(total)
            self.zeros.append(len(symbols) - int(total[-1]))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        start = np.zeros_like(end)
        for level, total in enumerate(self.planes):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start = np.where(one, self.zeros[level] + total[start], start - total[start])
            end = np.where(one, self.zeros[level] + total[end], end - total[end])
        return end - start


class FMIndex:
    """Backward search over one shard's words. Symbol 0 is the end, 1 a break between runs."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        suffixes = _suffix_array(symbols)
        self.bwt = symbols[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.tree = Wavelet(self.bwt, max(1, int(n_symbols).bit_length()))
        # Of the suffix array only the sampled positions stay, in order of their rows.
        self.sampled = suffixes % SAMPLE == 0
        self.positions = suffixes[self.sampled]
        self.place = np.cumsum(self.sampled, dtype=np.int32)

    def search(self, phrases: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are right-aligned in a matrix."""
        n = len(phrases)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((step < widths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk backwards until a sampled suffix."""
        walked, rows = np.zeros(len(rows), np.int64), rows.copy()
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.tree.rank(symbol, rows[live])
            walked[live] += 1
            live = live[~self.sampled[rows[live]]]
        return (self.positions[self.place[rows] - 1] + walked) % len(self.bwt)


def _suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all rotations of a text that ends in its one smallest symbol, by prefix doubling."""
    n, width, rank = len(symbols), 1, symbols
    while True:
        key = rank * (max(n, int(rank.max())) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if fresh[order[-1]] == n - 1:
            return order
        rank, width = fresh, width * 2


class Block:
    """Test phrases of a part of the benchmark."""

    def __init__(self, items: list[tuple[object, str]]):
        column = pa.array([text for _, text in items], pa.string())
        data, offsets = tk.utf8(column)
        words = tk.Words(tk.lowered(data), offsets, tk.ALNUM_WORD)
        self.hashes = np.unique(words.hashes())
        self.symbols = np.searchsorted(self.hashes, words.hashes()) + 2
        raw = words.data.tobytes()
        phrases: dict[tuple[int, ...], set[str | None]] = {}
        shown: dict[tuple[int, ...], bytes] = {}
        for (item, _), start, end in zip(items, words.first[:-1].tolist(), words.first[1:].tolist()):
            for at in range(start, max(start + 1, end - WINDOW + 1)) if end > start else ():
                stop = min(at + WINDOW, end)
                key = tuple(self.symbols[at:stop].tolist())
                phrases.setdefault(key, set()).add(None if item is None else str(item))
                if key not in shown:
                    shown[key] = b" ".join(raw[words.starts[i] : words.ends[i]] for i in range(at, stop))
        self.items = list(phrases.values())
        self.text = [shown[key] for key in phrases]
        self.widths = np.array([len(key) for key in phrases], np.int64)
        self.shortest = int(self.widths.min()) if len(self.widths) else 0
        self.phrases = np.zeros((len(phrases), WINDOW), np.int64)
        for i, key in enumerate(phrases):
            self.phrases[i, WINDOW - len(key) :] = key

    def hits(self, words: tk.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, phrase) of every occurrence in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.widths) or not len(words):
            return none
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        symbols = np.where(self.hashes[at] == hashes, at + 2, 1)
        # Runs of benchmark words inside one document, long enough for a phrase.
        known = symbols > 1
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        row_start = words.first[:-1][words.per_row > 0]
        begins[row_start] |= known[row_start]
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(known))
        gap = np.flatnonzero(~known)
        if len(gap):
            nearest = np.searchsorted(gap, starts)
            stops = np.minimum(stops, np.append(gap, len(known))[nearest])
        long = stops - starts >= self.shortest
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return none
        size = stops - starts + 1  # each run and a break
        place = np.concatenate([[0], np.cumsum(size)])
        origin = np.arange(place[-1]) - np.repeat(place[:-1] - starts, size)
        text = np.append(symbols[np.minimum(origin, len(symbols) - 1)], 0)
        text[place[1:] - 1] = 1
        index = FMIndex(text, len(self.hashes) + 1)
        low, high = index.search(self.phrases, self.widths)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        found = origin[index.locate(rows)]
        raw = words.data
        good = np.ones(len(found), bool)
        for i, (word, phrase) in enumerate(zip(found.tolist(), which.tolist())):
            part = range(word, word + int(self.widths[phrase]))
            good[i] = b" ".join(raw[words.starts[k] : words.ends[k]].tobytes() for k in part) == self.text[phrase]
        return found[good], which[good]


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcasts of the benchmark's blocks. Reads it part by part; no more than BLOCK_BYTES of text is held at once."""
    spark, out, part, size = benchmark.sparkSession, [], [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for item, text in rows.toLocalIterator():
        if part and size + len(text) > BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(Block(part)))
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    return out + [spark.sparkContext.broadcast(Block(part))]


def _let_go(block) -> None:
    """Drops a worker's copy of a broadcast; it is read again from the executor's file when next needed."""
    if getattr(block, "_path", None) is not None:
        block.__dict__.pop("_value", None)


class _Chunk:
    """Hits so far in a chunk of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words, self.offsets = tk.Words(tk.lowered(data), offsets, tk.ALNUM_WORD), offsets
        self.hashes = self.words.hashes()
        self.edge = np.zeros(len(self.words) + 1, np.int64)
        self.items: dict[int, set[str | None]] = {}

    def search(self, block: Block) -> None:
        found, which = block.hits(self.words, self.hashes)
        np.add.at(self.edge, found, 1)
        np.add.at(self.edge, found + block.widths[which], -1)
        rows = np.searchsorted(self.words.first, found, side="right") - 1
        for row, phrase in set(zip(rows.tolist(), which.tolist())):
            self.items.setdefault(row, set()).update(block.items[phrase])

    def verdicts(self) -> list[tuple]:
        words = self.words
        hit = np.cumsum(self.edge)[: len(words)] > 0
        n_hit = tk.row_sums(hit, words.first)
        nothing = hashlib.sha256(b"").hexdigest()
        out = []
        for row, (n, h) in enumerate(zip(words.per_row.tolist(), n_hit.tolist())):
            if not h:
                out.append((n, 0, 0, nothing, False, []))
                continue
            at = np.flatnonzero(hit[words.first[row] : words.first[row + 1]]) + words.first[row]
            cut = np.flatnonzero(np.diff(at) > 1)
            spans = zip(words.starts[at[np.append(0, cut + 1)]] - self.offsets[row], words.ends[at[np.append(cut, -1)]] - self.offsets[row])
            names = sorted(x for x in self.items[row] if x is not None)
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            out.append((n, h, len(self.items[row]), digest, 20 * h >= n, [(int(a), int(b)) for a, b in spans]))
        return out


def judged(data: np.ndarray, offsets: np.ndarray, blocks: list) -> list[tuple]:
    """(n_words, n_hit, n_items, items digest, contaminated, spans as [start, end) byte offsets) of each row."""
    return next(iter(_judged([(data, offsets)], blocks)))


def _judged(chunks: list[tuple[np.ndarray, np.ndarray]], blocks: list) -> list[list[tuple]]:
    """judged() of several chunks, block by block."""
    held = [_Chunk(*chunk) for chunk in chunks]
    for block in blocks:
        value = block.value if hasattr(block, "value") else block
        for chunk in held:
            chunk.search(value)
        if len(blocks) > 1:
            del value
            _let_go(block)
    return [chunk.verdicts() for chunk in held]


def _judged_parts(batches: Iterator[pa.RecordBatch], column: int, blocks: list) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Parts of batches with the verdicts of their rows."""
    parts, chunks, size = [], [], 0
    for batch in batches:
        for row, end, data, offsets in tk.chunks(batch.column(column)):
            parts.append(batch.slice(row, end - row))
            chunks.append((data, offsets))
            size += len(data)
            if len(blocks) == 1 or size >= GROUP_BYTES:
                yield from zip(parts, _judged(chunks, blocks))
                parts, chunks, size = [], [], 0
    if parts:
        yield from zip(parts, _judged(chunks, blocks))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: words, hit words, items found and whether it is contaminated. No shuffle."""
    blocks = blocks_of(benchmark)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _judged_parts(batches, 1, blocks):
            found = list(zip(*rows))
            found[5] = [",".join(f"{a}:{b}" for a, b in spans) for spans in found[5]]
            columns = [part.column(0)] + [pa.array(x, f.type) for x, f in zip(found, list(_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", excise: bool = False) -> DataFrame:
    """docs without contaminated documents, or (excise) with the merged removal spans cut out of their texts.

    All columns stay; documents that are not contaminated are left as they are. One pass, no shuffle.
    """
    blocks, schema, at = blocks_of(benchmark), docs.schema, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _judged_parts(batches, at, blocks):
            bad = np.array([x[4] for x in found], bool)
            if not excise:
                yield part.filter(pa.array(~bad))
                continue
            texts = part.column(at).to_pylist()
            for i in np.flatnonzero(bad):
                raw, kept, last = texts[i].encode(), [], 0
                for a, b in found[i][5]:
                    kept.append(raw[last:a])
                    last = b
                texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(clean, schema)
