"""Centroid clustering of embeddings by weighted deduplication: Lloyd's rounds over the distinct quantised vectors.

Components become integers, so equal vectors are equal byte strings. They are grouped with their multiplicities; rounds run over
the distinct ones and add weighted integer sums, so results are exact whatever the order of addition. At the end the
assignments are joined back to the ids.

What a round sends: each task a row for each cluster and dimension, summed by partial aggregation; the driver gets clusters times
dimensions numbers.

Heavy groups: copies of a vector are counted before they are shuffled. In the join back, vectors that are more than a HOT_PARTS-th of all
rows (so fewer than HOT_PARTS of them) are broadcast; no other key has more rows than that share.

Defined results for odd input: vectors that are null, have another number of components, or a null or non-finite one are left out; rows
with equal ids are rows of their own; a null id is hashed like an empty text and stays null; of rows with equal hashes the smaller vector (by
bytes) becomes the earlier centroid; fewer vectors than clusters give fewer clusters; further columns are ignored; an empty
table gives an empty result. Components beyond LARGEST after scaling are refused, for distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Largest component after scaling.
LARGEST = 1 << 26
#: Up to this size sums of products are exact in floating point.
_FLOAT_SAFE = 1 << 20
#: A vector is hot if it is more than this part of all rows.
HOT_PARTS = 1000

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_SUMS = "cluster int, dim int, total decimal(38,0), n decimal(38,0)"


def _packed(q: np.ndarray) -> pa.Array:
    """Rows of integers as byte strings: two bytes each where a row allows it, else four."""
    kind = "<i2" if not q.size or np.abs(q).max() < 1 << 15 else "<i4"
    width = q.shape[1] * int(kind[-1])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(np.ascontiguousarray(q, kind))]).cast(pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of a column of byte strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.empty((len(column), dims), np.int64)
    wide = pc.binary_length(column).to_numpy(zero_copy_only=False) == 4 * dims
    for mask, kind in ((~wide, "<i2"), (wide, "<i4")):
        if mask.any():
            raw = b"".join(column.filter(pa.array(mask)).to_pylist())
            out[mask] = np.frombuffer(raw, kind).reshape(-1, dims)
    return out


def quantised(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of vectors(vec_id, vector) that are whole: floor(scale * x) of each component, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, lists = batch.column(0).filter(fits), lists.filter(fits)
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.isfinite(x).all(axis=1)
            q = np.floor(x[whole] * float(scale))
            if q.size and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            ids, q = ids.filter(pa.array(whole)), q.astype(np.int64)
            wide = (np.abs(q) >= 1 << 15).any(axis=1)
            for mask in (~wide, wide):
                if mask.any():
                    yield pa.RecordBatch.from_arrays([ids.filter(pa.array(mask)), _packed(q[mask])], names=["vec_id", "v"])

    return vectors.mapInArrow(pack, "vec_id long, v binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, of equal ones the smallest; squared distance), exact."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if most <= _FLOAT_SAFE else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    squares = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    best = squares.argmin(axis=1)
    return best.astype(np.int32), squares[np.arange(len(x)), best].astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[list[int], int]]:
    """Exact weighted sums of the components of each cluster's vectors, and their number."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            x, w = unpacked(batch.column(0), dims), batch.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            # Products in 64 bits where they fit, else as Python's integers.
            kind = np.int64 if int(w.sum()) * LARGEST < 1 << 62 else object
            for j in np.unique(best).tolist():
                mine = best == j
                total[j] += (x[mine].astype(kind) * w[mine, None].astype(kind)).sum(axis=0).astype(object)
                n[j] += int(w[mine].sum())
        rows = [(j, d, Decimal(int(total[j, d])), Decimal(n[j])) for j in range(k) if n[j] for d in range(dims)]
        types = [pa.int32(), pa.int32(), pa.decimal128(38), pa.decimal128(38)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], names=["cluster", "dim", "total", "n"])

    found = distinct.select("v", "times").mapInArrow(add, _SUMS).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out: dict[int, tuple[list[int], int]] = {}
    for row in found.orderBy("cluster", "dim").collect():
        out.setdefault(row.cluster, ([], int(row.n)))[0].append(int(row.total))
    return out


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after some rounds over distinct(v, times): floor of the mean, empty clusters stay."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for j, (total, n) in _sums(distinct, centroids).items():
            centroids[j] = [t // n for t in total]
    return centroids


def first_centroids(points: DataFrame, clusters: int, dims: int, seed: int = 1) -> np.ndarray:
    """The vectors whose ids have the smallest hashes with the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = points.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).select("v").toArrow()
    return unpacked(first.column(0), dims)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each whole vector: its cluster, squared distance, the distances summed over cluster and table, the centroid's digest."""
    spark = vectors.sparkSession
    points = written(quantised(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), dims, scale), "vectors")
    distinct = written(points.groupBy("v").agg(F.count("*").alias("times")), "distinct-vectors")
    start = first_centroids(points, clusters, dims)
    if not len(start):
        return spark.createDataFrame([], SCHEMA)
    centroids = lloyd(distinct, start, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(unpacked(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(distance)], names=["v", "times", "cluster", "distance"])

    assigned = written(distinct.mapInArrow(assign, "v binary, times long, cluster int, distance long"), "assigned-vectors")
    weighted = F.col("times").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    per_cluster = assigned.groupBy("cluster").agg(F.sum(weighted).alias("inertia"), F.sum("times").alias("n")).collect()
    whole, rows = sum(int(r.inertia) for r in per_cluster), sum(r.n for r in per_cluster)
    told = [(r.cluster, int(r.inertia), whole, digest(centroids[r.cluster])) for r in per_cluster]
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))

    hot = F.col("times") * HOT_PARTS > F.lit(rows)
    assigned_hot = F.broadcast(assigned.where(hot).select("v", "cluster", "distance"))
    back = points.join(assigned_hot, "v").unionByName(points.join(assigned_hot.select("v"), "v", "left_anti").join(assigned.where(~hot).select("v", "cluster", "distance"), "v"))
    return back.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
