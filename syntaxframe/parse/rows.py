"""Trees as rows of the ``nodes`` relation.

A row is one node: preorder number, last descendant's number (so that ancestry is an interval test), parent, byte span, the
path of its ancestors' kinds, its children in order, and, for record nodes, the key-value pairs below it. Captures,
filters, merges and conversions are column expressions over these rows, so a plan needs no shuffle after parsing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa

from .runtime import Node
from .shapes import AnyPlaces, AnyText, Gathered, Shape

CHILD = "idx int, node_id int, field string, kind string, named boolean, extra boolean, missing boolean, start_byte int, end_byte int, text string, inner array<struct<node_id int, text string>>"
PAIR = (
    "owner int, idx int, node_id int, kind string, key string, value_id int, value_kind string, value_named boolean, value_text string, "
    "inner array<struct<node_id int, text string>>, items array<struct<node_id int, kind string, text string, inner array<struct<node_id int, text string>>>>"
)
COLUMNS = (
    "node_id int, last_id int, parent_id int, depth int, child_idx int, field string, kind string, named boolean, extra boolean, "
    "is_error boolean, is_missing boolean, start_byte int, end_byte int, start_row int, start_col int, end_row int, end_col int, "
    f"path string, text string, children array<struct<{CHILD}>>, pairs array<struct<{PAIR}>>"
)

_INNER = pa.list_(pa.struct([("node_id", pa.int32()), ("text", pa.string())]))
_CHILD = pa.struct(
    [("idx", pa.int32()), ("node_id", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("named", pa.bool_()), ("extra", pa.bool_())]
    + [("missing", pa.bool_()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("text", pa.string()), ("inner", _INNER)]
)
_ITEM = pa.struct([("node_id", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("inner", _INNER)])
_PAIR = pa.struct(
    [("owner", pa.int32()), ("idx", pa.int32()), ("node_id", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("value_id", pa.int32())]
    + [("value_kind", pa.string()), ("value_named", pa.bool_()), ("value_text", pa.string()), ("inner", _INNER), ("items", pa.list_(_ITEM))]
)
ARROW = [
    *((n, pa.int32()) for n in ("node_id", "last_id", "parent_id", "depth", "child_idx")),
    ("field", pa.string()), ("kind", pa.string()),
    *((n, pa.bool_()) for n in ("named", "extra", "is_error", "is_missing")),
    *((n, pa.int32()) for n in ("start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col")),
    ("path", pa.string()), ("text", pa.string()), ("children", pa.list_(_CHILD)), ("pairs", pa.list_(_PAIR)),
]


@dataclass(frozen=True)
class Wanted:
    """What a plan needs of the trees; the parser makes nothing else.

    kinds: node kinds that become rows (None: all). text: kinds whose text is kept (None: those of rows that are leaves).
    wrappers: kind -> inner leaf kinds. pair_kinds: children of a record that are its pairs. key_leaves: inner kinds of keys.
    deep: pairs of nested records too. children: does a plan look at the children? places: at numbers and places of nodes, too? (Without them
    these columns may be null, which spares work where nothing else has to be known of the nodes between.)
    """

    kinds: frozenset[str] | None = None
    text: frozenset[str] | None = None
    wrappers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pair_kinds: frozenset[str] = frozenset()
    key_leaves: dict[str, tuple[str, ...]] = field(default_factory=dict)
    deep: bool = False
    children: bool = True
    places: bool = True


class Places:
    """Byte offsets, rows and byte columns of code point positions."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        if not self.ascii:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            self.bytes = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)

    def byte(self, at: int) -> int:
        return at if self.ascii else self.bytes[at]

    def point(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.lines, at) - 1
        return row, self.byte(at) - self.byte(self.lines[row])


def tree_rows(root: Node, text: str, want: Wanted, places: Places | None = None) -> Iterator[tuple]:
    """Rows of a tree in preorder, in the order of COLUMNS."""
    ids: dict[int, int] = {}
    order: list[tuple[Node, int, int, int, str | None, str]] = []
    stack: list[tuple[Node, int, int, int, str | None, str]] = [(root, -1, 0, 0, None, "")]
    while stack:
        item = stack.pop()
        node, _, depth, _, _, path = item
        number = ids[id(node)] = len(order)
        order.append(item)
        if node.children:
            inner = f"{path}/{node.kind}"
            stack.extend((n, number, depth + 1, i, f, inner) for i, (f, n) in reversed([*enumerate(node.children)]))
    last = list(range(len(order)))
    for number in range(len(order) - 1, 0, -1):
        parent = order[number][1]
        last[parent] = max(last[parent], last[number])
    places = places or Places(text)

    def inner_of(node: Node, leaves) -> list[dict] | None:
        if leaves is None:
            return None
        return [{"node_id": ids[id(n)], "text": text[n.start : n.end]} for _, n in node.children if n.kind in leaves]

    def pairs_of(record: Node) -> list[dict]:
        out, owners = [], [record]
        while owners:
            owner = owners.pop()
            for i, (_, pair) in enumerate(owner.children):
                if pair.kind not in want.pair_kinds:
                    continue
                values = [n for f, n in pair.children if f == "value"]
                for key in (n for f, n in pair.children if f == "key"):
                    leaves = want.key_leaves.get(key.kind)
                    names = [text[key.start : key.end]] if leaves is None else [text[n.start : n.end] for _, n in key.children if n.kind in leaves]
                    for name in names:
                        for value in values:
                            out.append(
                                {
                                    "owner": ids[id(owner)], "idx": i, "node_id": ids[id(pair)], "kind": pair.kind, "key": name, "value_id": ids[id(value)],
                                    "value_kind": value.kind, "value_named": value.named, "value_text": text[value.start : value.end],
                                    "inner": inner_of(value, want.wrappers.get(value.kind)),
                                    "items": [
                                        {"node_id": ids[id(n)], "kind": n.kind, "text": text[n.start : n.end], "inner": inner_of(n, want.wrappers.get(n.kind))}
                                        for _, n in value.children
                                        if n.named
                                    ],
                                }
                            )
                if want.deep:
                    for value in values:
                        owners.append(value)
                        owners.extend(n for _, n in value.children if n.named)
        return out

    for number, (node, parent, depth, at, name, path) in enumerate(order):
        if want.kinds is not None and node.kind not in want.kinds:
            continue
        (row0, col0), (row1, col1) = places.point(node.start), places.point(node.end)
        keep = not node.children if want.text is None else node.kind in want.text
        kids = [
            {
                "idx": i, "node_id": ids[id(n)], "field": f, "kind": n.kind, "named": n.named, "extra": n.extra, "missing": n.missing,
                "start_byte": places.byte(n.start), "end_byte": places.byte(n.end),
                "text": text[n.start : n.end], "inner": inner_of(n, want.wrappers.get(n.kind)),
            }
            for i, (f, n) in enumerate(node.children)
        ] if want.children else None
        yield (
            number, last[number], parent if parent >= 0 else None, depth, at, name, node.kind, node.named, node.extra, node.error, node.missing,
            places.byte(node.start), places.byte(node.end), row0, col0, row1, col1, path, text[node.start : node.end] if keep else None, kids,
            pairs_of(node) if want.pair_kinds else None,
        )


def _listed(column: pa.Array) -> list:
    """Values of a column; equal texts in lists are one object."""
    if not pa.types.is_list(column.type) or not pa.types.is_string(column.type.value_type):
        return column.to_pylist()
    held = column.flatten().dictionary_encode()
    texts, sizes = held.dictionary.to_pylist(), column.value_lengths().to_pylist()
    inner = iter([None if k is None else texts[k] for k in held.indices.to_pylist()])
    return [None if n is None else [*islice(inner, n)] for n in sizes]


def parse_batches(
    batches: Iterator[pa.RecordBatch], tree_of: Callable[..., Node], want: Wanted, carried: list[str], known: Callable[..., tuple[Shape, Any] | None] | None = None,
    form: tuple[list[tuple[str, pa.DataType]], Callable[[tuple], tuple | None]] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (carried columns..., text, ...) to batches of (carried columns..., node columns). tree_of makes a tree of a text and
    what the columns behind it hold; known gives the shape and borders of texts whose tree is known. form: other columns, and what makes their row (or None) of a node's, whose
    texts and places may be those of a shape. Null texts give no rows."""
    made_columns, row_of = form or (ARROW, None)
    names, types, rows_of_shapes = [*carried, *(n for n, _ in made_columns)], [t for _, t in made_columns], {}

    def rows_in(*tree) -> Iterator[tuple]:
        return tree_rows(*tree) if row_of is None else filter(None, map(row_of, tree_rows(*tree)))

    def rows_of(shape: Shape) -> list[tuple]:
        if shape not in rows_of_shapes:
            rows_of_shapes[shape] = [*rows_in(shape.root, AnyText(), want, AnyPlaces())]
        return rows_of_shapes[shape]

    for batch in batches:
        owners: list[int] = []
        rows: list[tuple] = []
        shaped = Gathered()

        def out(taken, columns):
            kept = batch.select(range(len(carried))).take(pa.array(taken, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, *columns], names=names)

        def flush():
            made = out(owners, [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.nulls(0, t) for t in types])
            owners.clear()
            rows.clear()
            return made

        for i, (text, *more) in enumerate(zip(*map(_listed, batch.columns[len(carried) :]))):
            if text is not None:
                if known is not None and (found := known(text, *more)) is not None:
                    shaped.add(found[0], i, text, found[1])
                    continue
                for row in rows_in(tree_of(text, *more), text, want):
                    owners.append(i)
                    rows.append(row)
                if len(rows) >= 4096:
                    yield flush()
        for taken, columns in shaped.filled(rows_of, types):
            yield out(taken, columns)
        if rows or not shaped.held:
            yield flush()
