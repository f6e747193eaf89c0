"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint has 64 bits, each the majority among the XXH64 hashes of its 3-word shingles. Equal fingerprints
are grouped first. A vantage-point tree, built from a bounded sample of distinct fingerprints, then deals all of them
to shards: at each branch a fingerprint goes inside if its distance to the vantage point is at most the radius, else
outside, and to both if it is within MAX_BITS / 2 of the border. Two fingerprints that differ in at most MAX_BITS bits have
distances that differ by at most as much (triangle inequality), so they always meet in some shard. Shards go on
splitting in memory the same way and compare the last few directly. A shard passes on no pairs but a star for each of
its groups; components() joins the stars.

Defined results for odd input: null, empty and wordless texts have fingerprint zero, which links like any other; a text of
one or two words is one shingle; ids may be null or repeated (rows with one fingerprint are one group; the component's id is
its least id, null if it has none); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from . import textkit as tk
from .components import components
from .shared import fresh, last_if_null, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Distinct fingerprints that the driver sees, to choose vantage points. They steer the dealing, never the result. The tree has
#: at most SAMPLE_ROWS / 8 leaves, so beyond SHARD_ROWS times as many fingerprints (17 million) shards grow with the
#: data: at 10 billion fingerprints a shard has some 2.5 million, times the copies near borders (4 or 5 in measurements).
SAMPLE_ROWS = 1 << 15
#: Distinct fingerprints of one shard.
SHARD_ROWS = 1 << 12
#: Rows that both sides of a split hold together, as a multiple of the rows split.
MOST_COPIED = 1.3
#: Compared all with all inside a shard.
DIRECT_ROWS = 256

_U = np.uint64


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    low = tk.lowered(data)
    words = tk.Words(low, offsets, tk.PLAIN_WORD)
    per_row, raw, digest = words.per_row, low.tobytes(), xxhash.xxh64_intdigest
    # All words of the chunk joined by one space each: shingles are slices of it.
    joined = b" ".join([raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())])
    size = words.ends - words.starts
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    at = words.windows(SHINGLE)
    short = words.first[:-1][(per_row > 0) & (per_row < SHINGLE)]
    last = np.concatenate([at + SHINGLE - 1, words.first[1:][(per_row > 0) & (per_row < SHINGLE)] - 1])
    at = np.concatenate([at, short])
    order = np.argsort(at, kind="stable")
    at, last = at[order], last[order]
    stop = (start[last] + size[last]).tolist()
    found = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[at].tolist(), stop)), np.uint64, len(at))
    n = np.where(per_row < SHINGLE, np.minimum(per_row, 1), per_row - SHINGLE + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        for bit in range(64):
            ones = np.add.reduceat(((found >> _U(bit)) & _U(1)).astype(np.int32), first[full])
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << _U(bit)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in tk.chunks(batch.column(1)):
            prints = fingerprints(data, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(prints)], names=["doc_id", "print"])


def _sides(prints: np.ndarray, vantage: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints go inside and which outside; those near the border go both ways."""
    away = np.bitwise_count(prints ^ _U(vantage)).astype(np.int64)
    half = MAX_BITS // 2
    return away - half <= radius, away + (MAX_BITS - half) > radius


def _split(prints: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and radius that part the fingerprints, or None if too many are near any border: splitting such
    a ball would copy it into both sides over and over."""
    best, most = None, MOST_COPIED * len(prints)
    for k in range(4):
        vantage = int(prints[(len(prints) * (2 * k + 1)) // 8])
        radius = int(np.median(np.bitwise_count(prints ^ _U(vantage))))
        for r in (radius, radius - 1):
            inside, outside = _sides(prints, vantage, r)
            a, b = int(inside.sum()), int(outside.sum())
            if a + b <= most and (best is None or max(a, b) < best[0]):
                best = max(a, b), vantage, r
        if best and best[0] < 0.7 * len(prints):
            break
    return best[1:] if best and best[0] < 0.9 * len(prints) else None


def grow(sample: np.ndarray, least: int) -> list | None:
    """A tree [vantage, radius, inside, outside] over the sample; None is a leaf of about ``least`` sampled rows."""
    if len(sample) <= max(least, 8) or (cut := _split(sample)) is None:
        return None
    inside, outside = _sides(sample, *cut)
    return [*cut, grow(sample[inside], least), grow(sample[outside], least)]


def deal(tree: list | None, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, its fingerprints)."""
    stack, leaf = [(tree, prints)], 0
    while stack:
        node, held = stack.pop()
        if node is None:
            yield leaf, held
            leaf += 1
            continue
        inside, outside = _sides(held, node[0], node[1])
        stack += [(node[3], held[outside]), (node[2], held[inside])]


def pairs(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs among distinct fingerprints, in pieces, some more than once."""
    stack = [np.sort(prints)]
    while stack:
        held = stack.pop()
        cut = _split(held) if len(held) > DIRECT_ROWS else None
        if cut is not None:
            stack += [held[side] for side in _sides(held, *cut)]
        elif len(held) <= 4096:
            for a in range(0, len(held), 128):
                near = np.bitwise_count(held[a : a + 128, None] ^ held[None, :]) <= MAX_BITS
                i, j = np.nonzero(near)
                fine = i + a < j
                yield held[i[fine] + a], held[j[fine]]
        else:
            # A dense ball: look up every fingerprint at each of the few thousand differences; linear in the rows.
            for mask in _masks():
                other = held ^ mask
                at = np.minimum(np.searchsorted(held, other), len(held) - 1)
                fine = (held[at] == other) & (held < other)
                yield held[fine], other[fine]


def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array(one + [a | b for i, a in enumerate(one) for b in one[:i]], np.uint64)


def stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint with a link: itself and the least of its group inside this shard."""
    prints = np.unique(prints)
    label = np.arange(len(prints))

    def root(x: np.ndarray) -> np.ndarray:
        while (up := label[x]).tobytes() != x.tobytes():
            x = up
        return x

    # Pieces of pairs are joined as they come; they are never held together.
    for left, right in pairs(prints):
        a, b = np.searchsorted(prints, left), np.searchsorted(prints, right)
        while len(a):
            a, b = root(a), root(b)
            a, b = a[a != b], b[a != b]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    label = root(label)
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    leaf = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            u, v = stars(np.concatenate(held).view(np.uint64))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        names, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in _edges(names):
            if names[a] != leaf:
                yield from flush()
                leaf = names[a]
            held.append(prints[a:b].copy())
    yield from flush()


def _edges(names: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.append(np.flatnonzero(np.diff(names, prepend=names[:1] - 1)), len(names)) if len(names) else []
    yield from zip(cut[:-1], cut[1:])


def label_prints(prints: DataFrame) -> DataFrame:
    """(doc_id, print) to (print, root, component_id): each distinct fingerprint's component."""
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    n = distinct.count()
    # About SAMPLE_ROWS of the distinct fingerprints, chosen by their hashes, each task sending its share of them.
    chosen = F.pmod(F.xxhash64("print"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 40)))
    sample = [r[0] for r in distinct.where(chosen).select("print").collect()]
    sampled = np.sort(np.array(sample, np.int64).view(np.uint64))
    tree = grow(sampled, int(SHARD_ROWS * min(1, SAMPLE_ROWS / max(n, 1))))
    shards = sum(1 for _ in deal(tree, sampled[:0]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, held in deal(tree, batch.column(0).to_numpy().view(np.uint64)):
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), leaf, np.int32)), pa.array(held.view(np.int64))], names=["leaf", "print"])

    least = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = distinct.select("print").mapInArrow(dealt, "leaf int, print long").repartition(max(least, shards), "leaf")
    links = sharded.sortWithinPartitions("leaf").mapInArrow(_shard_links, "u long, v long")
    groups = distinct.join(components(links), F.col("print") == F.col("node"), "left")
    groups = groups.select("print", "least_id", F.coalesce("root", "print").alias("root"))
    ids = groups.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return groups.select("print", "root").join(ids, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(docs.mapInArrow(_fingerprint_rows, "doc_id long, print long"), "prints")
    out = prints.join(label_prints(prints).drop("root"), "print")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the least id (null ids last; of equal ids, any one). All columns stay.

    With a share, rows whose sets of five-word shingles have at least that Jaccard similarity are linked too."""
    names, types = docs.columns, docs.schema
    at = names.index(text_col)
    row_col, print_col, size_col, buckets_col = fresh(names, "_row", "_print", "_size", "_buckets")
    added = [T.StructField(row_col, T.LongType()), T.StructField(print_col, T.LongType())]
    if share is not None:
        added += [T.StructField(size_col, T.LongType()), T.StructField(buckets_col, T.ArrayType(T.LongType()))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tk.chunks(batch.column(at)):
                part = batch.slice(row, end - row)
                found = [pa.array(fingerprints(data, offsets).view(np.int64))]
                if share is not None:
                    found += jaccard.bucket_columns(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*names, *(f.name for f in added)])

    rows = docs.withColumn(row_col, F.monotonically_increasing_id())
    printed = written(rows.mapInArrow(add, T.StructType([*types.fields, *added])), "printed")
    keys = printed.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(print_col).alias("print"))
    groups = keys.join(label_prints(keys.select("doc_id", "print")), "print").select("row", "doc_id", "root")
    if share is not None:
        groups = written(groups, "print-groups")
        firsts = written(groups.groupBy("root").agg(F.min("row").alias("v"), F.max("row").alias("last")).where("v < last").select("root", "v"), "print-firsts")
        known = groups.join(firsts, "root").select(F.col("row").alias("u"), "v").where("u <> v")
        texts = printed.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"), F.col(size_col).alias("size"), F.col(buckets_col).alias("buckets"))
        labels = components(jaccard.near_links(texts, known, share)).withColumnRenamed("node", "row")
        groups = groups.drop("root").join(labels, "row", "left").withColumn("root", F.coalesce("root", "row"))
    first = F.min(F.struct(last_if_null(F.col("doc_id")).alias("id"), F.col("row")))
    kept = groups.groupBy("root").agg(first.alias("f"))
    return printed.join(kept.select(F.col("f.row").alias(row_col)), row_col, "left_semi").select(*names)
