"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole chunk of documents at once: words are byte runs, and a word's
identity is a 64-bit hash of all its bytes. Chunks are cut at document borders by total bytes, so memory follows the
chunk size and the longest single document, never the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at a time.
CHUNK_BYTES = 4 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _byte_table(other: str) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in (part.split("-") for part in other.split()):
        table[int(low, 16) : int(high, 16) + 1] = False
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
PLAIN_WORD = _byte_table("20-20 09-0D")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z became a-z).
ALNUM_WORD = _byte_table("00-2F 3A-60 7B-7F")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = wide.buffers()
    n = len(wide)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, at most ``limit`` bytes unless one row is larger."""
    data, at = utf8(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z, no other byte changes."""
    return _LOWER[data]


class Words:
    """Word borders of a chunk: byte ``starts`` and ``ends``, and ``first`` (word index at which each row begins)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[offsets[offsets < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[offsets[offsets > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from all its bytes and its length."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        length = self.ends - self.starts
        out = mix(length.astype(np.uint64) * _MULT ^ (lanes[self.starts] & _LANE[np.minimum(length, 8)]))
        more, k = np.flatnonzero(length > 8), 8
        while len(more) and k < 64:
            lane = lanes[self.starts[more] + k] & _LANE[np.minimum(length[more] - k, 8)]
            out[more] = mix(out[more] * _MULT ^ lane)
            k += 8
            more = more[length[more] > k]
        for i in more:
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def windows(self, n: int) -> np.ndarray:
        """Word indices at which n words of one row begin."""
        if len(self) < n:
            return np.zeros(0, np.int64)
        at = np.arange(len(self) - n + 1)
        return at[at + n <= np.repeat(self.first[1:], self.per_row)[: len(at)]]

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total[self.ends] - total[self.starts]


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive word hashes, made by doubling (len(hashes) - n + 1 values)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, width, steps = hashes, 1, bin(n)[3:]
    for bit in steps:
        out = mix(out[: len(out) - width] * _MULT + out[width:])
        width *= 2
        if bit == "1":
            out = mix(out[: len(hashes) - width] * _MULT + hashes[width:])
            width += 1
    return out


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it a second or later occurrence (in index order)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) for some start s."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
