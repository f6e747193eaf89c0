"""Rules as classes: the class body is the production.

Annotations are children in order, with the attribute's name as field: a rule class, ``Literal["="]`` for a token, ``list[X]``,
``X | Y`` and ``X | None``; the name ``content`` makes a child without a field. ``__body__`` takes any expression instead,
``__pattern__`` a regular expression.
"""

from __future__ import annotations

import ast
import inspect
import re
import sys
import textwrap
import types
import typing
from collections.abc import Iterable
from dataclasses import replace
from typing import Any, Literal, Union, get_args, get_origin

from ..errors import GrammarError
from . import dsl
from .dsl import Grammar, call_site, choice, field, opt, pattern, ref, repeat, token
from .ir import Expr, Site


def snake(name: str) -> str:
    """CamelCase to snake_case; a run of capitals is one word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


class Rule:
    """A rule with a body from annotations or ``__body__``."""

    __flags__: frozenset[str] = frozenset()

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        cls.__site__ = call_site()
        frame = sys._getframe(1)
        cls.__scope__ = dict(frame.f_locals) if frame.f_code.co_name != "<module>" else {}

    @classmethod
    def rule_name(cls) -> str:
        name = cls.__dict__.get("__rule_name__") or snake(cls.__name__)
        return f"_{name}" if issubclass(cls, Hidden) and not name.startswith("_") else name


class Pattern(Rule):
    """A leaf that is one regular expression."""


class Token(Rule):
    """A leaf wrapped as one token."""


class External(Rule):
    """A token from the grammar's scanner."""

    @classmethod
    def external_name(cls) -> str:
        return cls.__dict__.get("__external__") or cls.rule_name()


class Extra(Rule):
    """May stand anywhere."""


class Supertype(Rule):
    """Hidden in trees, listed in the schema as the kinds it may be."""


class Hidden(Rule):
    """Makes no node."""


class Inline(Rule):
    """Replaced by its body where it is used."""


class Word(Rule):
    """The grammar's word token."""


BASES = (Rule, Pattern, Token, External, Extra, Supertype, Hidden, Inline, Word)


def R(cls: type[Rule]) -> Expr:  # noqa: N802
    """A reference by class."""
    return ref(cls.rule_name())


def _annotation(cls: type[Rule], name: str, hint: Any) -> Expr:
    def one(h: Any) -> Expr:
        origin = get_origin(h)
        if inspect.isclass(h) and issubclass(h, Rule):
            return R(h)
        if origin is Literal:
            values = get_args(h)
            return dsl.as_expr(values[0]) if len(values) == 1 else choice(*values)
        if origin in (Union, types.UnionType):
            arms = [a for a in get_args(h) if a is not type(None)]
            made = one(arms[0]) if len(arms) == 1 else choice(*map(one, arms))
            return made
        raise GrammarError(f"{cls.__name__}.{name}: {h!r} is no rule annotation")

    def labelled(e: Expr, h: Any) -> Expr:
        # One fixed text needs no name; a choice of texts is what the attribute holds.
        return e if name == "content" or (get_origin(h) is Literal and len(get_args(h)) == 1) else field(name, e)

    origin = get_origin(hint)
    if origin in (list, typing.List):
        inner = get_args(hint)[0]
        return repeat(labelled(one(inner), inner))
    if origin in (Union, types.UnionType) and type(None) in get_args(hint):
        return opt(one(hint)) if name == "content" else field(name, opt(one(hint)))
    if origin is Literal and name in cls.__dict__ and cls.__dict__[name] not in get_args(hint):
        raise GrammarError(f"{cls.__name__}.{name}: the default {cls.__dict__[name]!r} is not one of {get_args(hint)}")
    return labelled(one(hint), hint)


def body_of(cls: type[Rule]) -> Expr:
    if "__body__" in cls.__dict__:
        body = dsl.as_expr(cls.__dict__["__body__"])
        return token(body) if issubclass(cls, Token) else body
    if "__pattern__" in cls.__dict__:
        body = pattern(cls.__dict__["__pattern__"])
        return token(body) if issubclass(cls, Token) else body
    try:
        hints = typing.get_type_hints(cls, localns={**cls.__scope__})
    except NameError as error:
        raise GrammarError(f"{cls.__name__}: {error}") from error
    own = [n for n in cls.__dict__.get("__annotations__", {}) or inspect.get_annotations(cls) if not n.startswith("__")]
    if not own:
        raise GrammarError(f"{cls.__name__} has no body")
    sites = attribute_sites(cls)
    parts = [replace(_annotation(cls, n, hints[n]), site=sites.get(n, cls.__site__)) for n in own]
    return parts[0] if len(parts) == 1 else dsl.seq(*parts)


def attribute_sites(cls: type[Rule]) -> dict[str, Site]:
    """Where each child of a rule class is declared, by its name; none where the source cannot be read."""
    try:
        lines, first = inspect.getsourcelines(cls)
    except (OSError, TypeError):
        return {}
    found: dict[str, Site] = {}
    for statement in ast.parse(textwrap.dedent("".join(lines))).body[0].body:
        if isinstance(statement, ast.AnnAssign) and isinstance(statement.target, ast.Name) and not statement.target.id.startswith("__"):
            at = statement.lineno - 1
            found[statement.target.id] = replace(cls.__site__, line=first + at, text=lines[at].strip())
    return found


def module_rules(module: Any) -> list[type[Rule]]:
    """Rule classes defined in a module, in order; imported ones are left out."""
    return [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Rule) and c.__module__ == module.__name__]


def assemble(name: str, *, start: type[Rule] | str, rules: Iterable[type[Rule]], default_whitespace: bool = True) -> Grammar:
    """The grammar of rule classes; their order is the order of rules and of externals."""
    g = Grammar(name, default_whitespace=default_whitespace, start=start if isinstance(start, str) else start.rule_name())
    for cls in rules:
        if cls in BASES:
            continue
        site: Site | None = cls.__site__
        if issubclass(cls, External):
            g.external(ref(cls.external_name()))
            if "__body__" not in cls.__dict__ and "__pattern__" not in cls.__dict__:
                if issubclass(cls, Extra):
                    g.extra(ref(cls.external_name()))
                continue
        g.rule(cls.rule_name(), body_of(cls), inline=issubclass(cls, Inline), supertype=issubclass(cls, Supertype), word=issubclass(cls, Word), site=site)
        if issubclass(cls, Extra):
            g.extra(ref(cls.rule_name()))
    return g
