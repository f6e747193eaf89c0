"""Pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least a given share.

Candidates share a MinHash bucket: BANDS keys a document, each over ROWS minima. A pair at similarity s shares none with
chance (1 - s^ROWS)^BANDS, 3 in 100,000 at 0.8 and less above. Every candidate pair is then checked over the whole sets.

Heavy groups: each document is first checked against the earliest row of its buckets alone, so a group of near copies costs
one check a row. Rows of buckets that these links have not joined are then compared through their rarest shingles (prefix
filter), which leaves out no pair that is similar enough.

A text of one to four words is one shingle; null, empty and wordless texts have none and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .shared import written

SHINGLE = 5
BANDS, ROWS = 20, 4

_U = np.uint64
_SEEDS = tk.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text of a chunk, ascending, and n + 1 borders of the texts."""
    low = tk.lowered(data)
    words = tk.Words(low, offsets, tk.PLAIN_WORD)
    at = words.windows(SHINGLE)
    row = words.rows()[at]
    found = tk.rolled(words.hashes(), SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.per_row > 0) & (words.per_row < SHINGLE))
    if len(short):
        raw = low.tobytes()
        one = [xxhash.xxh3_64_intdigest(b" ".join(raw[words.starts[i] : words.ends[i]] for i in range(words.first[r], words.first[r + 1]))) for r in short]
        row, found = np.concatenate([row, short]), np.concatenate([found, np.array(one, np.uint64)])
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.searchsorted(row[new], np.arange(len(offsets)))


def buckets(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of each text that has shingles (a row each, in order)."""
    full = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(full), BANDS), np.uint64)
    for band in range(BANDS) if len(full) else ():
        key = np.full(len(full), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = tk.mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat((found ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | _U(1)), full))
        out[:, band] = key
    return out


def bucket_columns(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For the texts of a chunk: how many distinct shingles each has, and its list of buckets."""
    found, first = shingles(data, offsets)
    size = np.diff(first)
    at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
    return pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(buckets(found, first).ravel().view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in tk.chunks(batch.column(1)):
            found, first = shingles(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists], names=["row", "set"])


def checked(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """(u, v) of the pairs(u, v) that are similar enough. texts: (row, text)."""
    wanted = written(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "wanted-sets")
    sets = written(texts.join(wanted, "row", "left_semi").mapInArrow(_sets, "row long, set array<long>"), "sets")
    left, right = sets.toDF("u", "a"), sets.toDF("v", "b")
    both = F.size(F.array_intersect("a", "b"))
    # Shares such as 0.8 have no exact double.
    return pairs.join(left, "u").join(right, "v").where(both >= share * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v")


def prefixes(rows: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """(shingle, row, root, size, left): of each of rows(row, root), the rarest of its shingles, so many that two sets that are similar
    enough have one of them in common (the others are too few for the share). Shingles of one row alone are left out.
    left: how many of the set are no rarer than the shingle, itself included."""
    sets = written(texts.join(rows.select("row"), "row", "left_semi").mapInArrow(_sets, "row long, set array<long>"), "open-sets")
    each = sets.select("row", F.explode("set").alias("shingle"))
    times = written(each.groupBy("shingle").agg(F.count("*").alias("times")), "shingle-times")
    ranked = each.join(times, "shingle").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("ranked"))
    size = F.size("ranked")
    ranked = ranked.select("row", size.alias("size"), F.slice("ranked", F.lit(1), (size - F.ceil(share * size - 1e-9) + 1).cast("int")).alias("rarest"))
    out = ranked.select("row", "size", F.posexplode("rarest").alias("place", "x")).where("x.times > 1").join(rows, "row")
    return written(out.select("x.shingle", "row", "root", "size", (F.col("size") - F.col("place")).alias("left")), "prefixes")


def near_links(rows: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Links (u, v) that, with the known ones, join what known and similarity of at least ``share`` join.

    rows: (row, text, size, buckets), as from bucket_columns; known: (u, v) over row.
    """
    texts = rows.select("row", "text")
    dealt = rows.select("row", "size", F.explode("buckets").alias("bucket"))
    firsts = dealt.groupBy("bucket").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    firsts = written(firsts.select("bucket", "first"), "buckets")
    dealt = written(dealt.join(firsts, "bucket"), "shared-buckets")
    tried = written(dealt.groupBy("row").agg(F.min("first").alias("v")).where("v < row").select(F.col("row").alias("u"), "v"), "tried-pairs")
    links = written(known.unionByName(checked(tried, texts, share)), "star-links")

    labels = written(components(links), "labels").withColumnRenamed("node", "row")
    open_ = dealt.select("bucket", "row", "size").join(labels, "row", "left").withColumn("root", F.coalesce("root", "row"))
    open_ = written(open_, "labelled-buckets")
    mixed = written(open_.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket"), "mixed-buckets")
    open_ = written(open_.join(mixed, "bucket").select("row", "root").distinct(), "open-rows")
    rarest = prefixes(open_, texts, share)
    left, right = (rarest.toDF("shingle", x, f"{x}_root", f"{x}_size", f"{x}_left") for x in ("u", "v"))
    # The smaller set is at least so large a share of the larger one.
    fits = F.least("u_size", "v_size") >= share * F.greatest("u_size", "v_size") - 1e-9
    # From their rarest common shingle on, both sets have room for all that they must have in common.
    fits &= F.least("u_left", "v_left") * (1 + share) >= share * (F.col("u_size") + F.col("v_size")) - 1e-9
    more = left.join(right, "shingle").where((F.col("u") > F.col("v")) & (F.col("u_root") != F.col("v_root")) & fits).select("u", "v").distinct()
    more = written(more.join(tried, ["u", "v"], "left_anti"), "other-pairs")
    return links.unionByName(checked(more, texts, share))
