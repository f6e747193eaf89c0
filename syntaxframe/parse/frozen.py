"""Trees as text, to be kept in the state of a stream.

A frozen node is its places and what stands there: start and end of each node in preorder, counted from the start of the first, and for each
field, kind, flags and number of children. It says nothing of where it stands in a text, so what an edit leaves alone or only moves
need not be frozen again, and nodes that differ in place alone are equal. A frozen tree is a frozen root, which has the places of the top-level
nodes, and a list of these, frozen.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import lru_cache
from typing import Any

import numpy as np

from .runtime import Node, Parser, Tree, kept_tree
from .shapes import LONGEST, Shape

#: Frozen nodes and shapes of trees that are remembered.
MOST_ENTRIES, MOST_SHAPES = 20_000, 2_000
#: Stretches of text whose nodes are remembered, and the longest of them.
MOST_STRETCHES, LONGEST_STRETCH = 40_000, 512


class Kept(Node):
    """A top-level node that stays frozen; only its place is at hand."""

    __slots__ = ("frozen",)

    def __init__(self, frozen: str, start: int, end: int):
        _, kind, flags, _ = _top(frozen.partition("|")[2])
        self.kind, self.named, self.start, self.end, self.children = kind, bool(flags & 1), start, end, ()
        self.extra, self.error, self.missing, self.frozen = bool(flags & 2), bool(flags & 4), bool(flags & 8), frozen


@lru_cache(maxsize=4096)
def _top(kinds: str) -> tuple:
    return tuple(json.loads(kinds)[:4])


def freeze(field: str | None, node: Node) -> str:
    if type(node) is Kept:
        return node.frozen
    places, kinds, stack, at = [], [], [(field, node)], node.start
    while stack:
        name, n = stack.pop()
        if type(n) is Kept:
            n = thaw(n.frozen, n.start)[1]
        places += [n.start - at, n.end - at]
        kinds += [name, n.kind, n.named + 2 * n.extra + 4 * n.error + 8 * n.missing, len(n.children)]
        stack.extend(reversed(n.children))
    return f"{_listed(places)}|{_listed(kinds)}"


def _listed(values: list) -> str:
    return json.dumps(values, separators=(",", ":"), ensure_ascii=False)


def thaw(text: str, at: int = 0) -> tuple[str | None, Node]:
    """(field, node) of a frozen node that starts at a place."""
    places, _, kinds = text.partition("|")
    return _built(json.loads(kinds), [at + p for p in json.loads(places)])


def _built(kinds: list, places: Any) -> tuple[str | None, Node]:
    top: list[tuple[str | None, Node]] = []
    waiting: list[tuple[list, int]] = [(top, 1)]
    for k in range(0, len(kinds), 4):
        name, kind, flags, n = kinds[k : k + 4]
        node = Node(kind, bool(flags & 1), places[k // 2], places[k // 2 + 1], [], bool(flags & 2), bool(flags & 4), bool(flags & 8))
        into, left = waiting.pop()
        into.append((name, node))
        if left > 1:
            waiting.append((into, left - 1))
        if n:
            waiting.append((node.children, n))
    return top[0]


def frozen_root(root: Node) -> str:
    """The root without its children, but with their places."""
    places = [root.start, root.end]
    for _, n in root.children:
        places += (n.start, n.end)
    return f"[{','.join(map(str, places))}]|{_bare(root.kind, root.named, root.extra, root.error, root.missing)}"


@lru_cache(maxsize=256)
def _bare(kind: str, named: bool, extra: bool, error: bool, missing: bool) -> str:
    return freeze(None, Node(kind, named, 0, 0, (), extra, error, missing)).partition("|")[2]


def frozen_marks(tree: Tree) -> str:
    return _listed(tree.marks)


def thawed(root: str, nodes: list[str], text: str, marks: str | None = None, kept: bool = False) -> Tree:
    """kept: top-level nodes stay frozen."""
    places, _, kinds = root.partition("|")
    places = json.loads(places)
    node = _built(json.loads(kinds), places)[1]
    at = range(2, len(places), 2)
    node.children = [(_top(n.partition("|")[2])[0], Kept(n, places[k], places[k + 1])) for k, n in zip(at, nodes)] if kept else [thaw(n, places[k]) for k, n in zip(at, nodes)]
    return kept_tree(node, text, [(a, b, tuple(s), n) for a, b, s, n in json.loads(marks)] if marks else [])


class Reparser:
    """Parses versions to trees whose top-level nodes are frozen. What becomes of a stretch of text between two states of the parser is
    remembered: frozen nodes say nothing of their place, so where the stretch comes again, in whatever document, they are taken as they are."""

    def __init__(self, parser: Parser):
        self.parser, self.stretches = parser, {}

    def parse(self, text: str) -> Tree:
        return self._kept(self.parser.parse(text, keep=True))

    def _kept(self, tree: Tree) -> Tree:
        tree.children = [(f, n if type(n) is Kept else Kept(freeze(f, n), n.start, n.end)) for f, n in tree.children]
        return tree

    def reparse(self, old: Tree, text: str) -> Tree:
        """Parser.reparse(): the same tree, with the same number of characters gone over. The old tree must not be used any more."""
        marks = old.marks
        if not marks or old.error or old.source == text or self.parser.looks_ahead:
            return self._kept(self.parser.reparse(old, text))
        first, tail, grown = self.parser.change(old, text)
        pos, _, states, n = (0, 0, None, 0) if first is None else marks[first]
        kept, last = first or 0, bisect_left(marks, tail, key=lambda m: m[0])
        # The nodes depend on the states at both ends and on the text up to the character behind the token at which the old tree is joined.
        if last < len(marks):
            at, end, after, m = marks[last]
            at, end, behind = at + grown, end + grown, old.children[m:]
        else:
            at, end, after, behind = len(text), len(text), None, []
        key = states, after, at - pos, end - pos, text[pos : end + 1]
        known, kinds = self.stretches.get(key), (old.kind, old.named, old.extra)
        if known is None or known[2] != kinds:
            tree = self._kept(self.parser.reparse(old, text))
            joined = tree.parsed == at - pos and bool(tree.marks) and not tree.error and (tree.kind, tree.named, tree.extra, tree.start, tree.end) == (*kinds, 0, len(text))
            if joined and end - pos < LONGEST_STRETCH:
                if len(self.stretches) >= MOST_STRETCHES:
                    self.stretches.clear()
                nodes = [(f, c.frozen, c.start - pos, c.end - pos) for f, c in tree.children[n : len(tree.children) - len(behind)]]
                new = [(a - pos, b - pos, s, k - n) for a, b, s, k in tree.marks[kept : len(tree.marks) - (len(marks) - last)]]
                self.stretches[key] = nodes, new, kinds
            return tree
        nodes, new, _ = known
        if grown:
            for _, node in behind:
                node.start += grown
                node.end += grown
        children = [*old.children[:n], *((f, Kept(frozen, pos + a, pos + b)) for f, frozen, a, b in nodes), *behind]
        added = n + len(nodes) - (len(old.children) - len(behind))
        new = [*marks[:kept], *((pos + a, pos + b, s, n + k) for a, b, s, k in new)]
        new += [(a + grown, b + grown, s, k + added) for a, b, s, k in marks[last:]] if grown or added else marks[last:]
        return kept_tree(Node(old.kind, old.named, 0, len(text), children, old.extra), text, new, at - pos)


class FrozenShape(Shape):
    """What is known of a text are the places of its root, as a text, and of each top-level node, from the node's start on."""

    def borders(self, known: list[tuple[str, list[np.ndarray]]]) -> np.ndarray:
        tops = np.array(json.loads(f"[{','.join([t for t, _ in known])}]"), np.int64)
        sizes = [len(places) for places in known[0][1]]
        if not sizes:
            return tops
        places = np.concatenate([p for _, nodes in known for p in nodes]).reshape(len(known), -1)
        return np.hstack([tops[:, :2], places + np.repeat(tops[:, 2::2], sizes, axis=1)])


class FrozenShapes:
    """The shapes of frozen trees: what stands in them, without places."""

    def __init__(self):
        self.entries: dict[str, tuple[str, np.ndarray]] = {}
        self.shapes: dict[tuple, Shape | None] = {}

    def _entry(self, frozen: str) -> tuple[str, np.ndarray]:
        places, _, kinds = frozen.partition("|")
        found = kinds, np.array(json.loads(places), np.int64)
        if len(self.entries) < MOST_ENTRIES:
            self.entries[frozen] = found
        return found

    def find(self, text: str, tree: list[str]) -> tuple[Shape, tuple[str, list[np.ndarray]]] | None:
        """(shape, places) of a tree whose shape was met before."""
        if len(text) > LONGEST or not text.isascii():
            return None
        tops, _, root = tree[0].partition("|")
        entries, known = [], self.entries
        for frozen in tree[1:]:
            entries.append(known.get(frozen) or self._entry(frozen))
        key = (root, *[kinds for kinds, _ in entries])
        shape = self.shapes.get(key)
        if shape is None:
            if key in self.shapes:
                shape = self.shapes[key] = self._shape(key)
            elif len(self.shapes) < MOST_SHAPES:
                self.shapes[key] = None
            if shape is None:
                return None
        return shape, (tops, [places for _, places in entries])

    def _shape(self, key: tuple) -> Shape:
        root, at = _built(json.loads(key[0]), (0, 1))[1], 2
        for kinds in map(json.loads, key[1:]):
            root.children.append(_built(kinds, range(at, at + len(kinds) // 2)))
            at += len(kinds) // 2
        return FrozenShape(root)
