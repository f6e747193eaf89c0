"""Relations between nodes of one document, by their preorder intervals.

``a`` is above ``b`` if a.node_id < b.node_id <= a.last_id. Intervals of a tree nest, so each relation is one pass over a
document's nodes in order, linear in their number; no pairs are made. Documents without an id (null) are one document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reached(nodes: DataFrame, outer: DataFrame, doc: str, itself: bool) -> DataFrame:
    """nodes with ``_reach``: the greatest last_id of the outer nodes that begin before each (or at it)."""
    names = nodes.columns
    rows = nodes.select(F.col(doc).alias("_doc"), F.col("node_id").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("int").alias("_to"), F.struct(*names).alias("_row"))
    above = outer.select(F.col(doc).alias("_doc"), F.col("node_id").alias("_at"), F.lit(0 if itself else 2).alias("_turn"), F.col("last_id").alias("_to"))
    both = rows.unionByName(above, allowMissingColumns=True)
    before = Window.partitionBy("_doc").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_reach", F.max("_to").over(before)).where("_turn = 1")
    return found.select("_row.*", (F.coalesce("_reach", F.lit(-1)) >= F.col("_at")).alias("_inside"))


def inside(nodes: DataFrame, outer: DataFrame, doc: str = "doc_id", itself: bool = False) -> DataFrame:
    """Nodes that stand below some node of ``outer`` (left semi); itself: or are one."""
    return _reached(nodes, outer, doc, itself).where("_inside").drop("_inside")


def outside(nodes: DataFrame, outer: DataFrame, doc: str = "doc_id", itself: bool = False) -> DataFrame:
    """Nodes that stand below none of ``outer`` (left anti); itself: and are none."""
    return _reached(nodes, outer, doc, itself).where("not _inside").drop("_inside")


def dotted_paths(rows: DataFrame, key: str, doc: str = "doc_id", sep: str = ".") -> DataFrame:
    """rows(doc, node_id, last_id, key, ...) with ``dotted``: the keys of all rows above and the row's own, outermost first.

    One pass over each document's rows in order, with a stack of the rows above; null keys are left out.
    """
    names = rows.columns
    at = [names.index(c) for c in (doc, "node_id", "last_id", key)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = object(), []
        for batch in batches:
            dotted = []
            for owner, node, last, name in zip(*(batch.column(i).to_pylist() for i in at)):
                if owner != now:
                    now, stack = owner, []
                while stack and stack[-1][0] < node:
                    stack.pop()
                own = ([stack[-1][1]] if stack and stack[-1][1] is not None else []) + ([] if name is None else [str(name)])
                stack.append((last, sep.join(own) if own else None))
                dotted.append(stack[-1][1] or "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dotted, pa.string())], names=[*names, "dotted"])

    schema = T.StructType([*rows.schema.fields, T.StructField("dotted", T.StringType())])
    return rows.repartition(doc).sortWithinPartitions(doc, "node_id", F.desc("last_id")).mapInArrow(walk, schema)


def at_span(nodes: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each span (doc, start_byte, end_byte), the first node with exactly these bytes."""
    firsts = nodes.groupBy(doc, "start_byte", "end_byte").agg(F.min_by(F.struct("node_id", "kind"), "node_id").alias("found"))
    return spans.join(firsts, [doc, "start_byte", "end_byte"]).select(spans["*"], "found.node_id", "found.kind")


#: Bytes of a document that are swept together.
RANGE_BYTES = 1 << 20


def covering(nodes: DataFrame, spans: DataFrame, doc: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each span (doc, start_byte, end_byte, ...), the innermost node that covers it: node_id and kind (null where none does) beside
    the span's columns.

    One sweep over the starts of nodes and spans, with a stack of the nodes that are open: their ends fall from the outermost to the innermost, so
    the node is found by halving, and no pairs are made. Long documents are swept in ranges of bytes by themselves: a node goes to
    each range that it reaches, which adds to the rows at most the depth for each range. An empty span belongs to what begins or goes on
    there, not to what ends; empty nodes cover nothing.
    """
    names = spans.columns
    own = ["_doc", "_range", "_at", "_turn", "_to", "_node", "_kind", "_span"]
    ranges = F.explode(F.sequence(F.floor(F.col("start_byte") / range_bytes), F.floor((F.col("end_byte") - 1) / range_bytes)))
    opened = nodes.where("end_byte > start_byte").select(F.col(doc).alias("_doc"), ranges.alias("_range"), F.col("start_byte").alias("_at"), F.lit(0).alias("_turn"), F.col("end_byte").alias("_to"), F.col("node_id").alias("_node"), F.col("kind").alias("_kind"))
    asked = spans.select(
        F.col(doc).alias("_doc"), F.floor(F.col("start_byte") / range_bytes).alias("_range"), F.col("start_byte").cast("int").alias("_at"), F.lit(1).alias("_turn"), F.col("end_byte").cast("int").alias("_to"),
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_span"),
    )
    both = opened.unionByName(asked, allowMissingColumns=True).select(*own)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, stack = object(), [], []
        for batch in batches:
            chosen, found = [], []
            for k, (owner, part, at, turn, to, node, kind) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)))):
                if (owner, part) != now:
                    now, ends, stack = (owner, part), [], []
                # Kept as negatives, which rise towards the innermost.
                while ends and -ends[-1] <= at:
                    ends.pop(), stack.pop()
                if turn == 0:
                    ends.append(-to), stack.append((node, kind))
                else:
                    place = bisect_right(ends, -to)
                    chosen.append(k)
                    found.append(stack[place - 1] if place else (None, None))
            spans_of = batch.column(7).take(pa.array(chosen, pa.int64()))
            columns = [spans_of, pa.array([n for n, _ in found], pa.int32()), pa.array([c for _, c in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_span", "node_id", "kind"])

    schema = T.StructType([T.StructField("_span", both.schema["_span"].dataType), T.StructField("node_id", T.IntegerType()), T.StructField("kind", T.StringType())])
    out = both.repartition("_doc", "_range").sortWithinPartitions("_doc", "_range", "_at", "_turn", "_node").mapInArrow(sweep, schema)
    return out.select("_span.*", "node_id", "kind")


def problems(nodes: DataFrame) -> DataFrame:
    """ERROR and missing nodes."""
    return nodes.where("is_error or is_missing")
