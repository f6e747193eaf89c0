"""Elements of pages: start and end tags, which the grammar leaves apart, are paired.

One pass over the tags of a document in order, with a stack of the elements that are open: linear, and no pairs of tags are made. The
result are intervals of node numbers, as ancestry's relations take them, so links below a ``nav`` are
``inside(links, elements(nodes).where("name = 'nav'"))``.

What ends an element: its end tag; the end tag of an element around it; a start tag that cannot stand in it (CLOSED_BY: list items, table
cells, options, terms, and paragraphs before blocks); else the end of the document. Void elements end with their start tag. An end tag of
nothing that is open is left out. Names are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Node kinds that the pairing needs, with their children.
KINDS = frozenset(("document", "element_start", "element_end", "link", "heading", "title", "script"))

# Elements without an end tag, and what stands for the end of one (HTML's optional tags).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: element -> start tags that end it.
CLOSED_BY = {
    "p": _BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")), "optgroup": frozenset(("optgroup",)),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "thead": frozenset(("tbody", "tfoot")), "tbody": frozenset(("tbody", "tfoot")),
    "head": frozenset(("body",)),
}
#: Elements beyond which a start tag ends nothing.
FENCES = frozenset(("ul", "ol", "menu", "dl", "table", "select", "button", "object", "template"))

SCHEMA = "node_id int, last_id int, name string, depth int, closed boolean, start_byte int, end_byte int"


class _Open:
    __slots__ = ("node", "name", "start")

    def __init__(self, node: int, name: str, start: int):
        self.node, self.name, self.start = node, name, start


class _Pairing:
    """The elements of one document, tag after tag."""

    def __init__(self, last: int, end: int):
        self.stack: list[_Open] = []
        self.last, self.end = last, end

    def _closed(self, down_to: int, last: int, end: int, own: bool) -> Iterator[tuple]:
        """Ends all elements from a place of the stack on. own: the lowest of them has an end tag of its own, whose last node this is."""
        while len(self.stack) > down_to:
            one = self.stack.pop()
            said = own and len(self.stack) == down_to
            yield one.node, last if said else max(one.node, self.before), one.name, len(self.stack), said, one.start, end if said else self.upto

    def start(self, node: int, last: int, name: str, begin: int, end: int) -> Iterator[tuple]:
        self.before, self.upto = node - 1, begin
        place = len(self.stack)
        for k in range(len(self.stack) - 1, -1, -1):
            open_ = self.stack[k].name
            if name in CLOSED_BY.get(open_, ()):
                place = k
            if open_ in FENCES:
                break
        yield from self._closed(place, 0, 0, False)
        if name in VOID:
            yield node, last, name, len(self.stack), True, begin, end
        else:
            self.stack.append(_Open(node, name, begin))

    def stop(self, node: int, last: int, name: str, begin: int, end: int) -> Iterator[tuple]:
        self.before, self.upto = node - 1, begin
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                yield from self._closed(k, last, end, True)
                return

    def finish(self) -> Iterator[tuple]:
        self.before, self.upto = self.last, self.end
        yield from self._closed(0, 0, 0, False)


def elements(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, node_id, last_id, name, depth, closed, start_byte, end_byte) of the elements in a nodes relation that has KINDS with their
    children. node_id is that of the start tag; depth counts the open elements around; closed: did it end with a tag of its own?"""
    child = lambda field: F.lower(F.get(F.filter("children", lambda c: c["field"] == field), F.lit(0))["text"])
    level, named = child("level"), child("name")
    name = F.when(F.col("kind") == "link", F.lit("a")).when(F.col("kind") == "title", F.lit("title")).when(F.col("kind") == "heading", F.substring(level, 2, 2)).when(F.col("kind") == "script", F.lit("script")).otherwise(named)
    tags = nodes.where(F.col("kind").isin(*KINDS)).select(F.col(doc).alias("_doc"), "node_id", "last_id", "kind", name.alias("name"), "start_byte", "end_byte")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = object(), None
        for batch in batches:
            docs, rows = [], []

            def keep(owner, found, docs=docs, rows=rows):
                for row in found:
                    docs.append(owner)
                    rows.append(row)

            for owner, node, last, kind, name, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != now or kind == "document":
                    if open_ is not None:
                        keep(now, open_.finish())
                    now, open_ = owner, _Pairing(last, end)
                if kind == "script":
                    keep(owner, [(node, last, name, len(open_.stack), True, begin, end)])
                elif kind == "element_end":
                    keep(owner, open_.stop(node, last, name, begin, end))
                elif kind != "document":
                    keep(owner, open_.start(node, last, name, begin, end))
            yield made(docs, rows)
        if open_ is not None:
            docs, rows = [], []
            for row in open_.finish():
                docs.append(now)
                rows.append(row)
            yield made(docs, rows)

    kind = nodes.schema[doc].dataType
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    if not isinstance(kind, (T.LongType, T.IntegerType, T.StringType)):
        raise TypeError(f"documents are told apart by integers or strings, not {kind.simpleString()}")
    names = ["_doc", *(f.split()[0] for f in SCHEMA.split(", "))]

    def made(docs: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(docs, arrow), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    ordered = tags.repartition("_doc").sortWithinPartitions("_doc", "node_id")
    return ordered.mapInArrow(pair, f"_doc {kind.simpleString()}, {SCHEMA}").withColumnRenamed("_doc", doc)
