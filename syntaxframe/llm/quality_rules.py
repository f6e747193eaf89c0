"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over the words of a whole chunk of documents, measure how many
characters of a document lie inside n-grams and lines that it has had before.

Defined results for odd input: a null or empty text has no words and fails the base rule; ids may be null or repeated (each
row is judged on its own); further columns are ignored; an empty table gives an empty result; a text of any length is
judged whole (memory follows the longest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Largest allowed part of a document's word characters inside repeats of n-grams (n: part), second and later occurrences.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest allowed part of its line characters inside lines that repeat an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + "".join(f"dup{n}_chars long, " for n in NGRAM_LIMITS)
    + "line_chars long, dup_line_chars long, base_failed boolean, kept boolean"
)
_TYPES = {"long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in SCHEMA.split(", "))])


def _line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row: lines equal to an earlier one, code points of all lines with a word, and of the repeats."""
    raw, out = data.tobytes(), np.zeros((3, len(offsets) - 1), np.int64)
    for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        seen: set[bytes] = set()
        for line in raw[start:end].split(b"\n"):
            if line.strip(_BLANK):
                size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
                out[1, row] += size
                if line in seen:
                    out[0, row] += 1
                    out[2, row] += size
                else:
                    seen.add(line)
    return tuple(out)


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of a chunk of texts, one value a row."""
    words = tk.Words(data, offsets, tk.PLAIN_WORD)
    hashes, points, first = words.hashes(), words.code_points(), words.first
    rows = words.rows().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": words.per_row, "word_chars": tk.row_sums(points, first)}
    out["n_symbols"] = np.diff(np.searchsorted(np.flatnonzero(symbol[data]), offsets))

    def keys(n: int, at: np.ndarray) -> np.ndarray:
        return tk.mix(tk.rolled(hashes, n)[at] + rows[at])

    at = words.windows(3)
    twice, _ = tk.repeated(keys(3, at))
    out["n_repeat_words"] = tk.row_sums(tk.covered(at[twice], 3, len(words)), first)
    # A window of n + 1 words repeats only if both its windows of n words do: each length looks at what the last one left.
    for n in NGRAM_LIMITS:
        at = words.windows(n) if n == min(NGRAM_LIMITS) else at[_fits(words, at, n)]
        twice, later = tk.repeated(keys(n, at)) if len(at) else (np.zeros(0, bool),) * 2
        out[f"dup{n}_chars"] = tk.row_sums(np.where(tk.covered(at[later], n, len(words)), points, 0), first)
        at = at[twice]
    out["n_dup_lines"], out["line_chars"], out["dup_line_chars"] = _line_counts(data, offsets)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    bad = out["dup_line_chars"] > LINE_LIMIT * out["line_chars"]
    for n, limit in NGRAM_LIMITS.items():
        bad |= out[f"dup{n}_chars"] > limit * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def _fits(words: tk.Words, at: np.ndarray, n: int) -> np.ndarray:
    ends = np.repeat(words.first[1:], words.per_row)
    return at + n <= ends[at] if len(at) else np.zeros(0, bool)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, end, data, offsets in tk.chunks(batch.column(1)):
            found = measured(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, end - row)] + [pa.array(found[f.name], f.type) for f in list(_ARROW)[1:]], schema=_ARROW
            )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, the base rule and the verdict ``kept``. No shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge, SCHEMA)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, with all their columns. One pass, no shuffle."""
    names, schema = docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            kept = [measured(data, offsets)["kept"] for _, _, data, offsets in tk.chunks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, schema)
