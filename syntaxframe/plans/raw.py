"""Raw tree queries: a small pattern language over trees, matched in the workers.

    (assignment left: (identifier) @name right: [(integer) (float)] @value (#match? @name "^[A-Z]"))

Patterns nest; children may have fields, ``_`` is any named node, ``"+"`` an anonymous one, ``?``, ``*`` and ``+`` quantify,
``.`` is not supported. Children match siblings in order. Each way to match is one match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as held_field
from typing import Any

import pyarrow as pa

from ..errors import QueryBuildError
from ..parse.rows import Places
from ..parse.runtime import Node, Parser
from ..parse.shapes import AnyPlaces, AnyText, Gathered, Shape, shapes_of

_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<string>"(?:[^"\\]|\\.)*")|(?P<capture>@[\w.-]+)|(?P<pred>#[\w?!.-]+)|(?P<name>[\w.-]+)(?P<colon>\s*:)?|(?P<mark>[()\[\]?*+])')


@dataclass
class Pattern:
    kind: str | None = None  # None: any named node
    named: bool = True
    field: str | None = None
    captures: tuple[str, ...] = ()
    quantifier: str = ""
    children: tuple[Pattern, ...] = ()
    options: tuple[Pattern, ...] = ()
    tests: list[tuple] = held_field(default_factory=list)

    def walk(self) -> Iterator[Pattern]:
        yield self
        for p in (*self.children, *self.options):
            yield from p.walk()

    def capture_names(self) -> set[str]:
        return {c for p in self.walk() for c in p.captures}

    def kinds(self) -> set[str]:
        return {p.kind for p in self.walk() if p.kind is not None}


def parse_query(source: str) -> list[Pattern]:
    """The top-level patterns of a query, or QueryBuildError."""
    tokens, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise QueryBuildError(f"tree query: {source[at:at + 12]!r} at {at} is not understood")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup if m.lastgroup != "colon" else "field", m.group("name") if m.lastgroup == "colon" else m.group().strip()))
    if not tokens:
        raise QueryBuildError("the tree query is empty")
    out, place, loose = [], 0, []

    def need(what: str):
        nonlocal place
        if place >= len(tokens) or tokens[place][1] != what:
            raise QueryBuildError(f"tree query: {what} expected")
        place += 1

    def text(token: str) -> str:
        return re.sub(r"\\(.)", r"\1", token[1:-1])

    def one() -> Pattern | None:
        nonlocal place
        name = None
        kind, value = tokens[place]
        if kind == "field":
            name, place = value, place + 1
            kind, value = tokens[place] if place < len(tokens) else ("", "")
        tests: list[tuple] = []
        if value == "(" and place + 1 < len(tokens) and tokens[place + 1][0] == "pred":
            place += 1
            loose.append(predicate())
            return None
        if value == "[":
            place += 1
            options = []
            while place < len(tokens) and tokens[place][1] != "]":
                options.append(one())
            need("]")
            found = Pattern(options=tuple(o for o in options if o))
        elif value == "(":
            place += 1
            if place < len(tokens) and tokens[place][1] == "(":
                inner = one()
                need(")")
                found = inner
            else:
                head_kind, head = tokens[place] if place < len(tokens) else ("", "")
                if head_kind != "name":
                    raise QueryBuildError(f"tree query: a kind is expected, not {head!r}")
                place += 1
                children = []
                while place < len(tokens) and tokens[place][1] != ")":
                    if tokens[place][1] == "(" and place + 1 < len(tokens) and tokens[place + 1][0] == "pred":
                        place += 1
                        tests.append(predicate())
                    else:
                        children.append(one())
                need(")")
                found = Pattern(None if head == "_" else head, children=tuple(c for c in children if c), tests=tests)
        elif kind == "string":
            place += 1
            found = Pattern(text(value), False)
        elif kind == "name" and value == "_":
            place += 1
            found = Pattern()
        else:
            raise QueryBuildError(f"tree query: {value!r} is not expected")
        found.field = name or found.field
        if place < len(tokens) and tokens[place][1] in "?*+":
            found.quantifier, place = tokens[place][1], place + 1
        while place < len(tokens) and tokens[place][0] == "capture":
            found.captures += (tokens[place][1][1:],)
            place += 1
        return found

    def predicate() -> tuple:
        nonlocal place
        name = tokens[place][1]
        place += 1
        arguments = []
        while place < len(tokens) and tokens[place][1] != ")":
            kind, value = tokens[place]
            arguments.append((kind, value[1:] if kind == "capture" else text(value) if kind == "string" else value))
            place += 1
        need(")")
        if name not in ("#match?", "#eq?", "#any-of?", "#not-eq?", "#not-match?") or not arguments or arguments[0][0] != "capture":
            raise QueryBuildError(f"tree query: predicate {name} is not supported")
        return (name, *arguments)

    while place < len(tokens):
        found = one()
        if found is not None:
            out.append(found)
    for test in loose:
        out[-1].tests.append(test)
    for p in out:
        for inner in p.walk():
            for test in inner.tests:
                if missing := {v for k, v in test[1:] if k == "capture"} - p.capture_names():
                    raise QueryBuildError(f"tree query: predicate on {sorted(missing)}, which is not captured")
    return out


def _single(pattern: Pattern, name: str | None, node: Node) -> bool:
    if pattern.field is not None and name != pattern.field:
        return False
    if pattern.kind is None:
        return node.named and not node.extra if not pattern.options else True
    return node.kind == pattern.kind and node.named == pattern.named


def matches_at(pattern: Pattern, name: str | None, node: Node) -> Iterator[list[tuple[str, Node]]]:
    """Each way in which a pattern matches a node: its captures in order."""
    if pattern.options:
        if pattern.field is not None and name != pattern.field:
            return
        for option in pattern.options:
            for found in matches_at(option, name, node):
                yield [*((c, node) for c in pattern.captures), *found]
        return
    if not _single(pattern, name, node):
        return
    own = [(c, node) for c in pattern.captures]
    if not pattern.children:
        yield own
        return
    for rest in _children(pattern.children, node.children, 0):
        yield own + rest


def _children(patterns: tuple[Pattern, ...], pairs, at: int) -> Iterator[list[tuple[str, Node]]]:
    if not patterns:
        yield []
        return
    first, rest = patterns[0], patterns[1:]
    met = False
    if first.quantifier in ("*", "+"):
        # All that match, as one; then what follows the last of them.
        taken, last = [], at
        for i in range(at, len(pairs)):
            for found in matches_at(first, *pairs[i]):
                taken += found
                last, met = i + 1, True
                break
        if met or first.quantifier == "*":
            yield from (taken + r for r in _children(rest, pairs, last if met and rest else at))
        return
    for i in range(at, len(pairs)):
        name, node = pairs[i]
        if first.options or _single(first, name, node):
            for found in matches_at(first, name, node):
                if not rest:
                    met = True
                    yield found
                    continue
                for r in _children(rest, pairs, i + 1):
                    met = True
                    yield found + r
    if first.quantifier == "?" and not met:
        yield from _children(rest, pairs, at)


def holds(tests: list[tuple], captures: dict[str, list[Node]], text: str) -> bool:
    for name, (_, subject), *arguments in tests:
        values = [captures[v][0].text(text) if k == "capture" and captures.get(v) else v for k, v in arguments]
        for node in captures.get(subject, ()):
            said = node.text(text)
            ok = bool(re.search(values[0], said)) if "match" in name else said in values
            if ok == name.startswith("#not"):
                return False
    return True


def _roots(pattern: Pattern) -> set[str | None]:
    """Kinds of nodes that a pattern can match; None stands for any."""
    return set().union(*map(_roots, pattern.options)) if pattern.options else {pattern.kind}


class Dispatch:
    """The patterns of a query by the kinds of nodes that they can match, and their tests; made once for all texts."""

    def __init__(self, patterns: list[Pattern]):
        self.anywhere = [(i, p) for i, p in enumerate(patterns) if None in _roots(p)]
        self.by_kind: dict[str | None, list[tuple[int, Pattern]]] = {}
        for kind in {k for p in patterns for k in _roots(p)} - {None}:
            self.by_kind[kind] = [(i, p) for i, p in enumerate(patterns) if _roots(p) & {None, kind}]
        self.tests = [[p.tests for p in pattern.walk() if p.tests] for pattern in patterns]


def query_matches(patterns: list[Pattern] | Dispatch, root: Node, text: str | None, scopes: frozenset[str] | None = None) -> Iterator[tuple[int, Node, dict[str, list[Node]]]]:
    """(pattern number, matched node, captures) over a whole tree, in document order.

    Without a text, the tests of patterns are left out. With scopes, only matches at or below a node of one of these kinds count (each once, however many such nodes stand above).
    """
    plan = patterns if isinstance(patterns, Dispatch) else Dispatch(patterns)
    by_kind, anywhere, tests = plan.by_kind, plan.anywhere, plan.tests
    inside = scopes is None
    stack: list[tuple[str | None, Node, bool]] = [(None, root, inside)]
    while stack:
        name, node, inside = stack.pop()
        inside = inside or node.kind in scopes
        for number, pattern in by_kind.get(node.kind, anywhere) if inside else ():
            for found in matches_at(pattern, name, node):
                captures: dict[str, list[Node]] = {}
                for c, n in found:
                    captures.setdefault(c, []).append(n)
                if text is None or not tests[number] or all(holds(t, captures, text) for t in tests[number]):
                    yield number, node, captures
        if node.children:
            stack.extend((f, n, inside) for f, n in reversed(node.children))


MATCHES = (
    "node_id int, pattern int, kind string, start_row int, start_col int, end_row int, end_col int, start_byte int, end_byte int, text string, "
    "captures map<string, array<struct<node_id int, text string>>>"
)
_CAPTURED = pa.map_(pa.string(), pa.list_(pa.struct([("node_id", pa.int32()), ("text", pa.string())])))
_TYPES = [pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 6, pa.string(), _CAPTURED]
_NAMES = [part.split()[0] for part in MATCHES.split(", ")[:10]] + ["captures"]


#: Trees of so many nodes share what a query matches in trees of their shape; so many shapes are remembered.
SHAPED_NODES, MOST_SHAPES = 200, 10_000


def _shape(root: Node) -> tuple[list[Node], tuple]:
    """Nodes in preorder, and all that patterns look at besides texts."""
    nodes, key, stack = [], [], [(None, root)]
    while stack:
        name, node = stack.pop()
        nodes.append(node)
        key.append((name, node.kind, node.named, node.extra, len(node.children)))
        if node.children:
            stack.extend(reversed(node.children))
    return nodes, tuple(key)


def _placed(plan: Dispatch, root: Node, nodes: list[Node], scopes: frozenset[str] | None) -> list[tuple[int, int, list[tuple[str, list[int]]]]]:
    """Matches before their tests, with nodes by their place in preorder."""
    ids = {id(n): k for k, n in enumerate(nodes)}
    return [(number, ids[id(node)], [(c, [ids[id(n)] for n in held]) for c, held in captures.items()]) for number, node, captures in query_matches(plan, root, None, scopes)]


def _row(nodes: list[Node], declared: list[str], text: Any, places: Any, number: int, node: int, captures: list[tuple[str, list[int]]]) -> tuple:
    """The row of a match, in the order of MATCHES."""
    by_name = dict(captures)
    at = nodes[by_name["_anchor"][0] if "_anchor" in by_name else next((by_name[d][0] for d in declared if by_name.get(d)), node)]
    shown = [(c, [{"node_id": k, "text": nodes[k].text(text)} for k in ids]) for c, ids in captures]
    return node, number, at.kind, *places.point(at.start), *places.point(at.end), places.byte(at.start), places.byte(at.end), at.text(text), shown


def match_batches(
    batches: Iterator[pa.RecordBatch], parser: Parser, source: str, declared: list[str], carried: list[str], scopes: frozenset[str] | None = None
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (carried..., text) to one row for each match. A match's place is that of the first declared capture."""
    plan, shapes = Dispatch(parse_query(source)), {}
    known, names, rows_of_shapes = shapes_of(parser), [*carried, *_NAMES], {}

    def rows_of(shape: Shape) -> list[tuple] | None:
        """The matches in a known shape; None where tests look at the texts."""
        if shape not in rows_of_shapes:
            nodes, _ = _shape(shape.root)
            found = _placed(plan, shape.root, nodes, scopes)
            tested = any(plan.tests[number] for number, _, _ in found)
            rows_of_shapes[shape] = None if tested else [_row(nodes, declared, AnyText(), AnyPlaces(), *f) for f in found]
        return rows_of_shapes[shape]

    for batch in batches:
        owners, rows, shaped = [], [], Gathered()

        def out(taken, columns):
            kept = batch.select(range(len(carried))).take(pa.array(taken, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, *columns], names=names)

        for i, text in enumerate(batch.column(len(carried)).to_pylist()):
            if text is None:
                continue
            same = known.find(text)
            if same is not None and rows_of(same[0]) is not None:
                shaped.add(same[0], i, text, same[1])
                continue
            root = parser.parse(text)
            nodes, key = _shape(root)
            found = shapes.get(key)
            if found is None:
                found = _placed(plan, root, nodes, scopes)
                if len(nodes) <= SHAPED_NODES and len(shapes) < MOST_SHAPES:
                    shapes[key] = found
            places = None
            for number, node, captures in found:
                tests = plan.tests[number]
                if tests:
                    held = {c: [nodes[k] for k in ids] for c, ids in captures}
                    if not all(holds(t, held, text) for t in tests):
                        continue
                places = places or Places(text)
                owners.append(i)
                rows.append(_row(nodes, declared, text, places, number, node, captures))
        for taken, columns in shaped.filled(rows_of, _TYPES):
            yield out(taken, columns)
        if rows or not shaped.held:
            yield out(owners, [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.nulls(0, t) for t in _TYPES])
