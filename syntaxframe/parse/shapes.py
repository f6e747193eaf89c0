"""Texts of a shape seen before: one regular expression in place of a parse, and columns made for many texts at once.

The tree of a text that is parsed by remembered moves follows from its tokens' names and from where extras stand between them. From a text that
was parsed so, an expression is made that matches the texts with the same tokens: at each token it asks for a first character with which the
lexer has no other pattern in that state, for none of the other literals, then for the token's own pattern, atomically. A text that it does not match is parsed as ever.

The rows of a shape are worked out once, with places in the list of token borders instead of positions, and filled in for all texts of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa

from ..grammar.tables import END
from .runtime import Node, Parser

#: Texts that are tried, at most this long; kinds of punctuation that are remembered; shapes of one kind.
LONGEST, MOST_SIGNS, MOST_SHAPES = 2048, 512, 4
#: Everything but punctuation, which tells apart most shapes.
_PLAIN = {ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_. \t\r\n"}
#: Assertions can let a pattern match nothing where it does not match the empty text; references count groups.
_ASSERTS = re.compile(r"\(\?(?:[=!]|<[=!]|P|\()|\$|(?<!\[)\^|\\[bBAZz1-9]")
_ASCII = [chr(c) for c in range(128)]


class Shape:
    """``root``: the tree, its positions being places in a text's list of borders. ``match``: (start, end) of the text and its tokens."""

    def __init__(self, root: Node, match: Callable[[str], Any] | None = None):
        self.root, self.match = root, match

    def borders(self, known: list[Any]) -> np.ndarray:
        """The borders of texts, one row each, from what was found of them."""
        return np.array(known, np.int64).reshape(len(known), -1)


class Shapes:
    """The shapes of the texts that a parser has met."""

    def __init__(self, parser: Parser):
        self.parser = parser
        self.able = parser.scanner is None and not parser.extra_starts
        self.held: dict[str, list] = {}  # punctuation: [texts without a shape, shapes]

    def find(self, text: str) -> tuple[Shape, Any] | None:
        """(shape, borders) of a text, if its shape is known."""
        if not self.able or len(text) > LONGEST or not text.isascii():
            return None
        sign = text.translate(_PLAIN)
        held = self.held.get(sign)
        if held is None:
            if len(self.held) < MOST_SIGNS:
                self.held[sign] = [1, []]
            return None
        for shape in held[1]:
            found = shape.match(text)
            if found is not None:
                return shape, found.regs
        # A shape is learnt when texts of its kind come again, ever more seldom.
        held[0] += 1
        if held[0] & (held[0] - 1) == 0 and held[0] <= 1 << MOST_SHAPES:
            shape = learnt(self.parser, text)
            if shape is not None:
                held[1].append(shape)
        return None


def shapes_of(parser: Parser) -> Shapes:
    """The shapes of a parser, kept with it."""
    if parser.shapes is None:
        parser.shapes = Shapes(parser)
    return parser.shapes


def _alone(parser: Parser, lexer: Any, name: str) -> tuple[str, int] | None:
    """An expression for a token where nothing else can stand, and its number of groups."""
    t = parser.t.terminals[name]
    if t.regex is None or t.external or r"\p" in t.regex:
        return None
    first, others = [], set()
    for ch in _ASCII:
        literals, patterns = lexer.candidates(ch)
        mine = [k for _, n, _, k in literals if n == name] if t.literal is not None else [n for _, n, _ in patterns if n == name]
        if len(mine) != 1 or mine[0] is True or len(patterns) != (t.literal is None):
            continue
        first.append(re.escape(ch))
        for literal, n, other, _ in literals:
            # Of two literals that both stand there, one may be sure to win.
            if n != name and not (t.literal is not None and t.literal.startswith(literal) and (t.prec, len(t.literal)) > (other.prec, len(literal))):
                others.add(f"(?!{re.escape(literal)})")
    if not first:
        return None
    inner = re.escape(t.literal) if t.literal is not None else t.regex
    if t.literal is None and (_ASSERTS.search(inner) or re.match(inner, "")):
        return None
    # Words that end like a reserved one are left to the lexer.
    ends = "".join(f"(?<!{re.escape(word)})" for word in sorted(lexer.reserved_text)) if name == parser.word_name else ""
    return f"(?=[{''.join(first)}]){''.join(sorted(others))}(?>{inner}){ends}", re.compile(inner).groups


def learnt(parser: Parser, text: str) -> Shape | None:
    """The shape of a text that remembered moves parse to its end, or None where its tokens are not certain without a lexer."""
    head = parser._quick(text)
    if head is None or head.token != "accepted":
        return None
    root = parser._root(head, text)
    if root.error:
        return None
    stack, pos, parts, count = parser._stack((0,)), 0, [], 0
    starts, ends = {0: 0}, {len(text): 1}
    while True:
        lexer, at, gap = stack.lexer, pos, None
        while True:
            best = parser._match(lexer, text, at, at == pos) if at < len(text) else (None, at, END)
            _, end, name = best
            if name not in parser.extras or name in stack.valid:
                break
            if parser.t.terminals[name].immediate or gap not in (None, name):
                return None
            gap, at = name, end
        if gap is not None:
            found = _alone(parser, lexer, gap)
            if found is None:
                return None
            parts.append(f"(?>(?:{found[0]})+)")
            count += found[1]
        if name == END:
            break
        found = _alone(parser, lexer, name)
        if found is None:
            return None
        count += 1
        parts.append(f"({found[0]})")
        starts.setdefault(at, 2 * count)
        ends.setdefault(end, 2 * count + 1)
        count += found[1]
        stack, pos = stack.moves[name][2], end

    def placed(node: Node) -> Node:
        start, stop = starts.get(node.start, ends.get(node.start)), ends.get(node.end, starts.get(node.end))
        return Node(node.kind, node.named, start, stop, [(f, placed(n)) for f, n in node.children], node.extra, node.error, node.missing)

    try:
        shape = Shape(placed(root), re.compile("".join(parts)).fullmatch)
    except (re.error, RecursionError):
        return None
    found = shape.match(text)
    if found is None or any(n.start is None or n.end is None for n in shape.root.walk()):
        return None
    return shape


# Rows of a shape, to be filled in.


class Border(NamedTuple):
    """A number that depends on the text: the byte, row or column of a border."""

    what: str
    at: int


class Cut(NamedTuple):
    """The text between two borders."""

    start: int
    end: int


class AnyText:
    def __getitem__(self, at: slice) -> Cut:
        return Cut(at.start, at.stop)


class AnyPlaces:
    def byte(self, at: int) -> Border:
        return Border("byte", at)

    def point(self, at: int) -> tuple[Border, Border]:
        return Border("row", at), Border("column", at)


class Filled:
    """Columns of rows with borders, over ASCII texts of one shape: all rows of the first text, then those of the second."""

    def __init__(self, texts: list[str], borders: np.ndarray):
        self.texts, self.n, self.byte = texts, len(texts), borders
        self._breaks: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._points: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._lists: dict[int, list[int]] = {}
        self._cuts: dict[Cut, list[str]] = {}

    def number(self, value: Any) -> Any:
        if not isinstance(value, Border):
            return value
        if value.what == "byte":
            return self.byte[:, value.at]
        return self._point(value.at)[value.what == "column"]

    def _point(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of a border."""
        if self._breaks is None:
            sizes = np.array([len(t) for t in self.texts])
            base, breaks = np.cumsum(sizes) - sizes, np.flatnonzero(np.frombuffer("".join(self.texts).encode(), np.uint8) == 10)
            self._breaks = base, breaks, np.searchsorted(breaks, base)
        if at not in self._points:
            base, breaks, first = self._breaks
            place = base + self.byte[:, at]
            before = np.searchsorted(breaks, place)
            begins = np.where(before > first, np.concatenate([[0], breaks + 1])[before], base)
            self._points[at] = before - first, place - begins
        return self._points[at]

    def cut(self, value: Any) -> list[Any]:
        if not isinstance(value, Cut):
            return [value] * self.n
        found = self._cuts.get(value)
        if found is None:
            starts, ends = (self._lists.setdefault(at, self.byte[:, at].tolist()) for at in value)
            found = self._cuts[value] = [t[a:b] for t, a, b in zip(self.texts, starts, ends)]
        return found

    def column(self, values: list[Any], kind: pa.DataType) -> pa.Array:
        if not values:
            return pa.array([], kind)
        if all(v is None for v in values):
            return pa.nulls(self.n * len(values), kind)
        if pa.types.is_list(kind) or pa.types.is_map(kind):
            sizes = np.tile(np.array([0 if v is None else len(v) for v in values]), self.n)
            none = np.tile(np.array([v is None for v in values]), self.n)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            offsets = pa.array(offsets, pa.int32(), mask=np.append(none, False)) if none.any() else pa.array(offsets, pa.int32())
            inner = [x for v in values if v is not None for x in v]
            if pa.types.is_map(kind):
                return pa.MapArray.from_arrays(offsets, self.column([k for k, _ in inner], kind.key_type), self.column([x for _, x in inner], kind.item_type))
            return pa.ListArray.from_arrays(offsets, self.column(inner, kind.value_type), type=kind)
        if pa.types.is_struct(kind):
            return pa.StructArray.from_arrays([self.column([v[f.name] for v in values], f.type) for f in kind], fields=[*kind])
        if any(isinstance(v, Cut) for v in values):
            return pa.array(list(chain.from_iterable(zip(*map(self.cut, values)))), kind)
        if any(isinstance(v, Border) for v in values):
            out = np.empty((self.n, len(values)), np.int32)
            for j, v in enumerate(values):
                out[:, j] = self.number(v)
            return pa.array(out.reshape(-1), kind)
        return pa.array(values, kind).take(pa.array(np.tile(np.arange(len(values)), self.n)))


class Gathered:
    """Texts of a batch by their shapes, each with its row in the batch."""

    #: Rows that are filled in at once.
    ROWS = 16_384

    def __init__(self):
        self.held: dict[Shape, tuple[list[int], list[str], list[Any]]] = {}

    def add(self, shape: Shape, i: int, text: str, borders: Any) -> None:
        held = self.held.get(shape)
        if held is None:
            held = self.held[shape] = [], [], []
        held[0].append(i)
        held[1].append(text)
        held[2].append(borders)

    def filled(self, rows_of: Callable[[Shape], list[tuple]], types: list[pa.DataType]):
        """(rows in the batch, columns) of all shapes that have rows."""
        for shape, (owners, texts, borders) in self.held.items():
            rows = rows_of(shape)
            if not rows:
                continue
            step, columns = max(1, self.ROWS // len(rows)), [*zip(*rows)]
            for k in range(0, len(texts), step):
                made = Filled(texts[k : k + step], shape.borders(borders[k : k + step]))
                yield np.repeat(np.array(owners[k : k + step], np.int64), len(rows)), [made.column([*c], t) for c, t in zip(columns, types)]
