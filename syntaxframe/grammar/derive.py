"""Node schemas from grammars: a fixpoint over productions.

Each rule's productions are summed up as: which visible nodes it brings, under which fields, at least and at most how many
times. Hidden rules pass what they bring to their parents; supertypes are listed by their subtypes.
"""

from __future__ import annotations

from collections import defaultdict

from ..schema import ChildInfo, NodeSchema, NodeTypeInfo, NodeTypeRef
from .ir import GrammarModel
from .tables import END, Production, Tables, build_tables

#: Counts above one are all the same.
_MANY = 2


class _Summary:
    """What a symbol brings: slot (field or None) -> (types, least, most); None under "" counts named nodes without a field."""

    def __init__(self):
        self.types: dict[str | None, set[NodeTypeRef]] = defaultdict(set)
        self.least: dict[str | None, int] = {}
        self.most: dict[str | None, int] = defaultdict(int)

    def state(self):
        return {k: frozenset(v) for k, v in self.types.items()}, dict(self.least), dict(self.most)


def derive_schema(grammar: GrammarModel, tables: Tables | None = None) -> NodeSchema:
    tables = tables or build_tables(grammar)
    by_head: dict[str, list[Production]] = defaultdict(list)
    groups = [tables, *tables.extra_rules.values()]
    for t in groups:
        for p in t.productions:
            if p.head != "~start" and p not in by_head[p.head]:
                by_head[p.head].append(p)
    hidden, supers = tables.hidden, tables.supertypes
    terminals = {k: v for t in groups for k, v in t.terminals.items()}
    sums: dict[str, _Summary] = defaultdict(_Summary)

    def visible(step) -> NodeTypeRef | None:
        """The one node that a step brings, if it brings a node of its own."""
        if step.alias is not None:
            return NodeTypeRef(step.alias, step.alias_named)
        if step.symbol in terminals:
            t = terminals[step.symbol]
            return None if t.kind is None else NodeTypeRef(t.kind, t.named)
        if step.symbol in supers:
            return NodeTypeRef(step.symbol, True)
        return None if step.symbol in hidden else NodeTypeRef(step.symbol, True)

    def brings(p: Production) -> tuple[dict, dict, dict]:
        types, least, most = defaultdict(set), defaultdict(int), defaultdict(int)
        for step in p.steps:
            own = visible(step)
            if own is not None:
                slot = step.field
                if slot is None and not own.named:
                    continue
                types[slot].add(own)
                least[slot] += 1
                most[slot] += 1
            elif step.symbol in by_head:
                below = sums[step.symbol]
                for slot, refs in below.types.items():
                    to = slot if slot is not None else step.field
                    types[to] |= refs
                    least[to] += below.least.get(slot, 0)
                    most[to] += below.most[slot]
        return types, least, most

    changed = True
    while changed:
        changed = False
        for head, productions in by_head.items():
            before, s = sums[head].state(), sums[head]
            found = [brings(p) for p in productions]
            slots = {slot for types, _, _ in found for slot in types}
            for slot in slots:
                for types, _, most in found:
                    s.types[slot] |= types.get(slot, set())
                    s.most[slot] = min(_MANY, max(s.most[slot], most.get(slot, 0)))
                s.least[slot] = min(_MANY, min(least.get(slot, 0) for _, least, _ in found))
            # A helper that takes itself in repeats what it brings.
            if any(step.symbol == head for p in productions for step in p.steps):
                for slot in slots:
                    s.most[slot] = _MANY
            changed |= before != s.state()

    entries: dict[tuple[str, bool], NodeTypeInfo] = {}
    extras = {terminals[e].kind for e in tables.extras if terminals[e].kind} | set(tables.extra_rules)

    def covered(refs: set[NodeTypeRef]) -> tuple[NodeTypeRef, ...]:
        """Without kinds that a listed supertype stands for."""
        under = {sub for r in refs if r.type in supers for sub in _subtypes(r.type)}
        return tuple(sorted(refs - under, key=lambda r: (r.type, not r.named)))

    def _subtypes(kind: str) -> set[NodeTypeRef]:
        return {r for p in by_head.get(kind, ()) for step in p.steps if (r := visible(step))}

    def info(s: _Summary, slot: str | None) -> ChildInfo:
        return ChildInfo(s.most[slot] > 1, s.least.get(slot, 0) > 0, covered(s.types[slot]))

    def add(kind: str, named: bool, source: str | None) -> None:
        s = sums.get(source) if source in by_head else None
        held = entries.get((kind, named))
        fields = {slot: info(s, slot) for slot in s.types if slot is not None} if s else {}
        children = info(s, None) if s and s.types.get(None) else None
        if held and held.fields:
            fields = {**held.fields, **fields}
        children = children or (held.children if held else None)
        inner = named and (source in by_head or bool(fields) or children is not None)
        entries[kind, named] = NodeTypeInfo(
            kind, named, fields if inner else None, children, (), kind == tables.start, kind in extras and named
        )

    for kind in supers:
        entries[kind, True] = NodeTypeInfo(kind, True, None, None, tuple(sorted(_subtypes(kind), key=lambda r: (r.type, not r.named))))
    for head in by_head:
        if head not in hidden:
            add(head, True, head)
    for productions in by_head.values():
        for p in productions:
            for step in p.steps:
                if step.alias is not None:
                    add(step.alias, step.alias_named, step.symbol)
                elif (own := visible(step)) and step.symbol in terminals and (own.type, own.named) not in entries:
                    add(own.type, own.named, None)
    for name in (*tables.extras, *tables.externals):
        t = terminals.get(name)
        if t is not None and t.kind is not None and name != END and (t.kind, t.named) not in entries:
            add(t.kind, t.named, None)
    return NodeSchema(sorted(entries.values(), key=NodeTypeInfo._order))
