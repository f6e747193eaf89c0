"""Trees as S-expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..language import Language, _worker_parser
from ..parse.runtime import Node


def _quoted(kind: str) -> str:
    return '"' + kind.replace("\\", "\\\\").replace('"', '\\"') + '"'


def render(node: Node, *, anonymous: str = "keep", fields: bool = False) -> str:
    """Canonical form: ``(kind child ...)``, anonymous tokens quoted by kind (anonymous="drop" leaves them out)."""
    if not node.named and not node.error:
        return _quoted(node.kind)
    parts = [f"MISSING {node.kind}" if node.missing else node.kind]
    for name, child in node.children:
        if child.named or child.error or anonymous == "keep":
            shown = render(child, anonymous=anonymous, fields=fields)
            parts.append(f"{name}: {shown}" if fields and name else shown)
    return f"({' '.join(parts)})"


def render_compact(node: Node, expressions: frozenset[str] = frozenset(("binary", "unary", "parenthesized", "call"))) -> str:
    """Expressions as bare parentheses, anonymous tokens by their text; other named nodes keep their names."""
    if not node.named:
        return node.kind
    inner = " ".join(render_compact(c, expressions) for _, c in node.children)
    if node.kind in expressions:
        return f"({inner})"
    return f"({node.kind} {inner})" if inner else f"({node.kind})"


STYLES = {"sexp": render, "compact": render_compact}


def select_node(root: Node, kind: str | None) -> Node | None:
    """The root, or the first node of a kind."""
    return root if kind is None else next((n for n in root.walk() if n.kind == kind), None)


def rendered(docs: DataFrame, language: Language, *, style: str = "sexp", selector: str | None = None, text_col: str = "text", **options: Any) -> DataFrame:
    """docs with ``rendered``: the tree of each text (or its first node of a kind), null where there is none. options: of the style."""
    carried = [c for c in docs.columns if c != text_col]
    sent = language._sent(docs.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema), f"`{text_col}` string", "rendered string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(len(carried)).to_pylist():
                node = None if text is None else select_node(_worker_parser(sent).parse(text), selector)
                found.append(None if node is None else STYLES[style](node, **options))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*carried, text_col, "rendered"])

    return docs.select(*carried, F.col(text_col)).mapInArrow(run, schema)
