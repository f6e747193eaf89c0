"""Grammar authoring with combinators.

Functions make expressions, ``Grammar`` collects rules, and ``Ladder`` keeps precedence levels in order. Expressions and
rules remember the line that made them, so that checks and conflicts can point there.
"""

from __future__ import annotations

import linecache
import re
import sys
from collections.abc import Iterable
from pathlib import Path
from types import MappingProxyType
from typing import Union

from ..errors import GrammarError
from .ir import PRECEDENCES, Expr, GrammarModel, Site

Body = Union[Expr, "Sugar", str]
_HERE = str(Path(__file__).parent)


def call_site() -> Site | None:
    """The nearest line outside this folder."""
    frame = sys._getframe(1)
    while frame is not None and frame.f_code.co_filename.startswith(_HERE):
        frame = frame.f_back
    if frame is None:
        return None
    file, line = frame.f_code.co_filename, frame.f_lineno
    return Site(file, line, linecache.getline(file, line).strip())


class Sugar:
    """An expression with operators: ``a + b`` is a sequence, ``a | b`` a choice."""

    def __init__(self, body: Body):
        self.expr = as_expr(body)

    def __add__(self, other: Body) -> Sugar:
        return Sugar(seq(self, other))

    def __radd__(self, other: Body) -> Sugar:
        return Sugar(seq(other, self))

    def __or__(self, other: Body) -> Sugar:
        return Sugar(choice(self, other))

    def __ror__(self, other: Body) -> Sugar:
        return Sugar(choice(other, self))

    @property
    def opt(self) -> Sugar:
        return Sugar(opt(self))

    @property
    def star(self) -> Sugar:
        return Sugar(repeat(self))

    @property
    def plus(self) -> Sugar:
        return Sugar(repeat1(self))

    def capture(self, name: str) -> Sugar:
        return Sugar(field(name, self))


B = Sugar


def as_expr(body: Body) -> Expr:
    """A string is a literal token; Sugar is unwrapped."""
    if isinstance(body, Expr):
        return body
    if isinstance(body, Sugar):
        return body.expr
    if isinstance(body, str):
        return Expr("STRING", value=body, site=call_site())
    raise GrammarError(f"not a rule body: {body!r}")


def _of(kind: str, bodies: Iterable[Body]) -> Expr:
    """Members of the same kind are taken up, as nesting them says nothing."""
    members: list[Expr] = []
    for body in map(as_expr, bodies):
        members.extend(body.members if body.kind == kind else (body,))
    return Expr(kind, members=tuple(members), site=call_site())


def seq(*bodies: Body) -> Expr:
    return _of("SEQ", bodies)


def choice(*bodies: Body) -> Expr:
    return _of("CHOICE", bodies)


def _around(kind: str, body: Body, **parts) -> Expr:
    return Expr(kind, content=as_expr(body), site=call_site(), **parts)


def repeat(body: Body) -> Expr:
    return _around("REPEAT", body)


def repeat1(body: Body) -> Expr:
    return _around("REPEAT1", body)


def blank() -> Expr:
    return Expr("BLANK", site=call_site())


def opt(body: Body) -> Expr:
    return choice(body, blank())


def ref(name: str) -> Expr:
    return Expr("SYMBOL", name=name, site=call_site())


def pattern(regex: str, flags: str | None = None) -> Expr:
    return Expr("PATTERN", value=regex, flags=flags, site=call_site())


def field(name: str, body: Body) -> Expr:
    return _around("FIELD", body, name=name)


def token(body: Body) -> Expr:
    return _around("TOKEN", body)


tok = token


def immediate_token(body: Body) -> Expr:
    return _around("IMMEDIATE_TOKEN", body)


def alias(body: Body, name: str, named: bool = True) -> Expr:
    """A rename. A bare sequence has no single node to rename."""
    expr = as_expr(body)
    if expr.kind == "SEQ":
        raise GrammarError(f"alias {name!r} over a sequence: give the sequence a rule of its own")
    return _around("ALIAS", expr, value=name, named=named)


def prec(level: int | str, body: Body) -> Expr:
    return _around("PREC", body, value=level)


def prec_left(level: int | str, body: Body) -> Expr:
    return _around("PREC_LEFT", body, value=level)


def prec_right(level: int | str, body: Body) -> Expr:
    return _around("PREC_RIGHT", body, value=level)


def prec_dynamic(level: int, body: Body) -> Expr:
    return _around("PREC_DYNAMIC", body, value=level)


def reserved(context: str, body: Body) -> Expr:
    return _around("RESERVED", body, context_name=context)


def is_blank_pattern(expr: Expr) -> bool:
    """Does a pattern match nothing but white space?"""
    if expr.kind in ("TOKEN", "IMMEDIATE_TOKEN"):
        return is_blank_pattern(expr.content)
    if expr.kind == "STRING":
        return bool(expr.value) and not str(expr.value).strip()
    if expr.kind != "PATTERN":
        return False
    atoms = r"(?:\\[snrtfv]|\\u00[aA]0|\\ufeff|\\u2028|\\u2029|\s)"
    return re.fullmatch(rf"(?:{atoms}|\[{atoms}+\]|\|)+(?:[*+?]|(?<=[*+?]){atoms})*", str(expr.value)) is not None


class Ladder:
    """Precedence levels, loosest first. A level's number is its place when it is used."""

    def __init__(self, *levels: str):
        self.levels: list[str] = []
        for level in levels:
            self._check(level)
            self.levels.append(level)

    def _check(self, level: str) -> None:
        if not level or level in self.levels:
            raise GrammarError(f"empty or repeated precedence level: {level!r}")

    def insert(self, level: str, *, before: str | None = None, after: str | None = None) -> Ladder:
        self._check(level)
        if (before is None) == (after is None):
            raise GrammarError("insert takes either before or after")
        self.levels.insert(self.n(before) - 1 if before else self.n(after), level)
        return self

    def n(self, level: str) -> int:
        if level not in self.levels:
            raise GrammarError(f"no precedence level {level!r} among {self.levels}")
        return self.levels.index(level) + 1

    __getitem__ = __call__ = n

    def ordering(self) -> list[str]:
        """Tightest first, as named precedences are listed."""
        return self.levels[::-1]

    def prec(self, level: str, body: Body) -> Expr:
        return prec(self.n(level), body)

    def left(self, level: str, body: Body) -> Expr:
        return prec_left(self.n(level), body)

    def right(self, level: str, body: Body) -> Expr:
        return prec_right(self.n(level), body)


class Grammar:
    """Collects rules and options; ``build`` makes the grammar."""

    def __init__(self, name: str, *, default_whitespace: bool = True, start: str = "source_file"):
        self.name, self.default_whitespace, self._start = name, default_whitespace, start
        self.rules: dict[str, Expr] = {}
        self.sites: dict[str, Site] = {}
        self._inline: list[str] = []
        self._supertypes: list[str] = []
        self._extras: list[Expr] = []
        self._conflicts: list[list[str]] = []
        self._orders: list[list[Expr]] = []
        self._externals: list[Expr] = []
        self._reserved: dict[str, list[Expr]] = {}
        self._word: str | None = None

    # Views.
    start_rule = property(lambda self: self._start if self._start in self.rules else next(iter(self.rules), self._start))
    extras_view = property(lambda self: tuple(self._extras))
    externals_view = property(lambda self: tuple(self._externals))
    word_view = property(lambda self: self._word)
    reserved_view = property(lambda self: MappingProxyType({k: tuple(v) for k, v in self._reserved.items()}))
    rules_view = property(lambda self: MappingProxyType(self.rules))
    sites_view = property(lambda self: MappingProxyType(self.sites))
    conflicts_view = property(lambda self: tuple(map(tuple, self._conflicts)))
    inline_view = property(lambda self: tuple(self._inline))
    supertypes_view = property(lambda self: tuple(self._supertypes))
    precedences_view = property(lambda self: tuple(map(tuple, self._orders)))

    def start(self, name: str) -> Grammar:
        self._start = name
        return self

    def rule(
        self,
        name: str,
        body: Body,
        *,
        hidden: bool = False,
        inline: bool = False,
        supertype: bool = False,
        word: bool = False,
        ambiguous: bool | Iterable[str] = False,
        dynamic: int | None = None,
        site: Site | None = None,
    ) -> Expr:
        """Adds a rule and returns a reference to it."""
        if hidden and not name.startswith("_"):
            name = f"_{name}"
        if name in self.rules:
            raise GrammarError(f"rule {name!r} is defined twice: {self.sites.get(name)} and {call_site()}")
        self._set(name, body, inline, supertype, word, ambiguous, dynamic, site)
        return ref(name)

    def replace_rule(self, name: str, body: Body, **flags) -> Expr:
        """A new body and new flags for a rule that exists; what the old flags did is undone."""
        if name not in self.rules:
            raise GrammarError(f"no rule {name!r} to replace")
        for held in (self._inline, self._supertypes):
            if name in held:
                held.remove(name)
        if self._word == name:
            self._word = None
        self._conflicts = [c for c in self._conflicts if name not in c]
        get = flags.get
        self._set(name, body, get("inline", False), get("supertype", False), get("word", False), get("ambiguous", False), get("dynamic"), get("site"))
        return ref(name)

    def _set(self, name, body, inline, supertype, word, ambiguous, dynamic, site) -> None:
        expr = as_expr(body)
        if ambiguous or dynamic is not None:
            expr = prec_dynamic(dynamic or 0, expr) if dynamic is not None or expr.kind not in PRECEDENCES else expr
        if ambiguous:
            self.ambiguous(name, *([] if ambiguous is True else ambiguous))
        if word:
            self.word(name)
        self.rules[name] = expr
        self.sites[name] = site or call_site()
        self._inline += [name] * inline
        self._supertypes += [name] * supertype

    def ambiguous(self, *names: str) -> Grammar:
        return self.conflict(*names)

    def conflict(self, *names: str) -> Grammar:
        if list(names) not in self._conflicts:
            self._conflicts.append(list(names))
        return self

    def word(self, name: str) -> Grammar:
        if self._word not in (None, name):
            raise GrammarError(f"two word rules: {self._word} and {name}")
        self._word = name
        return self

    def extra(self, *bodies: Body) -> Grammar:
        self._extras += map(as_expr, bodies)
        return self

    def external(self, *bodies: Body) -> Grammar:
        self._externals += [ref(b) if isinstance(b, str) else as_expr(b) for b in bodies]
        return self

    def reserved_word(self, context: str, *words: Body) -> Grammar:
        self._reserved.setdefault(context, []).extend(map(as_expr, words))
        return self

    def precedence(self, *levels: str) -> Ladder:
        """A ladder of named levels, loosest first, which is part of the grammar."""
        ladder = Ladder(*levels)
        self.precedence_ordering(*ladder.ordering())
        return ladder

    def precedence_ordering(self, *levels: Body) -> Grammar:
        """Named levels or rules, tightest first."""
        found = [as_expr(x) for x in levels]
        if not found or len(set(found)) < len(found):
            raise GrammarError("a precedence ordering is empty or repeats a level")
        self._orders.append(found)
        return self

    def build(self) -> GrammarModel:
        first = self.start_rule
        order = [first, *(k for k in self.rules if k != first)] if first in self.rules else list(self.rules)
        extras = list(self._extras)
        if self.default_whitespace and not any(is_blank_pattern(e) for e in extras):
            extras.insert(0, Expr("PATTERN", value=r"\s"))
        return GrammarModel(
            self.name, {k: self.rules[k] for k in order}, extras, [list(c) for c in self._conflicts], [list(o) for o in self._orders],
            list(self._externals), list(self._inline), list(self._supertypes), self._word, {k: list(v) for k, v in self._reserved.items()}, dict(self.sites),
        )

    def emit_json(self, path: str | Path) -> Path:
        return self.build().emit_json(path)

    def production_site(self, rule: str, symbols: Iterable[str]) -> Site | None:
        """Where the alternative of a rule was written that gives a production with these symbols, or else where the rule was."""
        found = matching_alternative(self.rules[rule], symbols) if rule in self.rules else None
        return (found.site if found is not None else None) or self.sites.get(rule)


def matching_alternative(expr: Expr, symbols: Iterable[str]) -> Expr | None:
    """The alternative of a rule body whose symbols begin as given: the author's line for a production. Literals and patterns may be
    given as they are or as tables name them, in quotes or slashes."""
    wanted = list(symbols)

    def names(e: Expr) -> list[tuple[str, ...]]:
        leaves = [x for x in e.walk() if x.kind in ("SYMBOL", "STRING", "PATTERN")]
        return [(x.name,) if x.name else (str(x.value), f"'{x.value}'", f"/{x.value}/") for x in leaves]

    def begins(e: Expr) -> bool:
        found = names(e)
        return len(found) >= len(wanted) and all(w in n for w, n in zip(wanted, found))

    options = [m for e in expr.walk() if e.kind == "CHOICE" for m in e.members] or [expr]
    return min(filter(begins, options), key=lambda e: len(names(e)), default=None)
