"""Field-mode models whose captures follow from the kinds and fields of nodes alone: worked out where the trees are, once for each shape.

field_rows() of plans.extract looks for captures in each anchor's children, by expressions over arrays that Spark interprets. Where no
capture depends on a text, the nodes captured are the same in all trees of a shape, so the worker gives the captured texts themselves: a row is an
anchor, with a text for each capture and the number of nodes that it could be. Values and failures are made from these by the expressions of
plans.extract, as ever. What this does not serve (lists, conditions on texts, wrappers) is left to field_rows().
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa

from ..model import Binding
from ..parse.rows import ARROW
from .analyze import Checked
from .paths import path_regex

#: What a row has of its anchor, before its captures; the last only where a model asks for spans.
ANCHOR, SPAN = ("node_id", "kind", "start_byte", "end_byte", "start_row", "start_col"), ("end_row", "end_col", "text")
_AT = {name: i for i, (name, _) in enumerate(ARROW)}


def serves(checked: Checked) -> bool:
    spec = checked.spec
    if spec.raw is not None or spec.record:
        return False
    return not any(b.is_list or b.predicates or b.nested is not None or _wrapped(b, checked) for b in spec.captures)


def _wrapped(b: Binding, checked: Checked) -> bool:
    """May the text of a capture be that of a node inside it?"""
    return bool(checked.values and checked.values.wrappers) and "str" in b.targets and not b.unescape


@dataclass(frozen=True)
class Form:
    """What the workers have to know of a model, whose class may not be theirs."""

    anchors: frozenset[str]
    above: str | None
    captures: tuple[tuple[str, str, frozenset[str], bool], ...]  # source, key, kinds, required
    anchor: tuple[str, ...]

    @classmethod
    def of(cls, checked: Checked) -> Form:
        spec = checked.spec
        captures = tuple((b.source, b.key, frozenset(checked.kinds.get(b.name, b.kinds)), b.required) for b in spec.captures)
        spans = any(b.targets == ("span",) for b in spec.bindings)
        return cls(frozenset(spec.path.anchors), path_regex(spec.path), captures, ANCHOR + SPAN if spans else ANCHOR)

    @property
    def columns(self) -> list[tuple[str, pa.DataType]]:
        types, n = dict(ARROW), range(len(self.captures))
        return [*((name, types[name]) for name in self.anchor), *((f"_t{i}", pa.string()) for i in n), *((f"_n{i}", pa.int32()) for i in n)]

    @property
    def schema(self) -> str:
        names = {pa.string(): "string", pa.int32(): "int"}
        return ", ".join(f"`{name}` {names[kind]}" for name, kind in self.columns)

    def made(self) -> tuple[list[tuple[str, pa.DataType]], Callable[[tuple], tuple | None]]:
        """The columns, and what makes them of a row of the nodes relation."""
        return self.columns, captured(self)


def captured(form: Form) -> Callable[[tuple], tuple | None]:
    """A row of the nodes relation to one of the form's columns, or None where the node is no anchor or lacks a required capture. The rules are
    those of field_rows()."""
    above = None if form.above is None else re.compile(form.above)
    bindings, anchors, anchor = form.captures, form.anchors, [_AT[name] for name in form.anchor]
    chain = [i for i, (*_, required) in enumerate(bindings) if required]
    kind_at, named_at, path_at, children_at = (_AT[n] for n in ("kind", "named", "path", "children"))

    def row_of(row: tuple) -> tuple | None:
        if row[kind_at] not in anchors or not row[named_at] or (above is not None and above.search(row[path_at]) is None):
            return None
        found = [[c for c in row[children_at] if c[source] == key and c["named"] and (not kinds or c["kind"] in kinds)] for source, key, kinds, _ in bindings]
        low, high, bound = {}, {}, -1
        for i in chain:
            bound = low[i] = min((c["idx"] for c in found[i] if c["idx"] > bound), default=None)
            if bound is None:
                return None
        bound = 1 << 30
        for i in reversed(chain):
            bound = high[i] = max(c["idx"] for c in found[i] if c["idx"] < bound)
        texts, numbers = [], []
        for i, (source, key, _, required) in enumerate(bindings):
            if required:
                held = [c for c in found[i] if low[i] <= c["idx"] <= high[i]]
            else:
                up, down = [low[j] for j in chain if j < i][-1:], [high[j] for j in chain if j > i][:1]
                held = [c for c in found[i] if (not up or c["idx"] > up[0]) and (not down or c["idx"] < down[0])]
                # Optional captures of one field take what those before them left.
                held = held[sum(other[:2] == (source, key) and not other[3] for other in bindings[:i]) :]
            texts.append(held[0]["text"] if held else None)
            numbers.append(len(held))
        return (*(row[k] for k in anchor), *texts, *numbers)

    return row_of
