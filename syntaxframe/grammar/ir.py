"""Grammar intermediate representation: rule expressions and the grammar that holds them.

Every expression is one immutable ``Expr``; KINDS says which parts each kind has. Equality ignores where an expression was
written (``site``). The JSON form is the common interchange format of grammars (``{"type": "SEQ", "members": [...]}``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..errors import GrammarError

#: The parts of each kind, by their JSON names.
KINDS: dict[str, tuple[str, ...]] = {
    "SYMBOL": ("name",),
    "STRING": ("value",),
    "PATTERN": ("value", "flags"),
    "BLANK": (),
    "SEQ": ("members",),
    "CHOICE": ("members",),
    "REPEAT": ("content",),
    "REPEAT1": ("content",),
    "FIELD": ("name", "content"),
    "ALIAS": ("value", "named", "content"),
    "TOKEN": ("content",),
    "IMMEDIATE_TOKEN": ("content",),
    "PREC": ("value", "content"),
    "PREC_LEFT": ("value", "content"),
    "PREC_RIGHT": ("value", "content"),
    "PREC_DYNAMIC": ("value", "content"),
    "RESERVED": ("context_name", "content"),
}
PRECEDENCES = frozenset(("PREC", "PREC_LEFT", "PREC_RIGHT", "PREC_DYNAMIC"))
TOKENS = frozenset(("TOKEN", "IMMEDIATE_TOKEN"))
SCHEMA_URL = "https://tree-sitter.github.io/tree-sitter/assets/schemas/grammar.schema.json"


@dataclass(frozen=True)
class Site:
    """Where a rule or expression was written."""

    file: str
    line: int
    text: str = ""

    def __str__(self) -> str:
        return f"{self.file}:{self.line}" + (f": {self.text}" if self.text else "")


@dataclass(frozen=True)
class Expr:
    kind: str
    content: Expr | None = None
    members: tuple[Expr, ...] = ()
    name: str | None = None
    value: str | int | None = None
    named: bool | None = None
    flags: str | None = None
    context_name: str | None = None
    site: Site | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise GrammarError(f"unknown kind of rule expression: {self.kind}")
        if self.kind == "PREC_DYNAMIC" and not isinstance(self.value, int):
            raise GrammarError("a dynamic precedence is an integer")

    def parts(self) -> tuple[Expr, ...]:
        return self.members if self.content is None else (self.content,)

    def walk(self) -> Iterator[Expr]:
        """This expression and all below it, depth first."""
        stack = [self]
        while stack:
            now = stack.pop()
            yield now
            stack.extend(reversed(now.parts()))

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.kind}
        for part in KINDS[self.kind]:
            value = getattr(self, part)
            if part == "members":
                out[part] = [m.to_json() for m in value]
            elif part == "content":
                out[part] = value.to_json()
            elif value is not None:
                out[part] = value
        return out

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> Expr:
        kind = data.get("type")
        if kind not in KINDS:
            raise GrammarError(f"unknown kind of rule expression: {kind!r}")
        extra = set(data) - {"type", *KINDS[kind]}
        if extra:
            raise GrammarError(f"{kind} does not take {sorted(extra)}")
        parts: dict[str, Any] = {k: data[k] for k in KINDS[kind] if k in data}
        missing = [k for k in KINDS[kind] if k not in parts and k != "flags"]
        if missing:
            raise GrammarError(f"{kind} needs {missing}")
        if "members" in parts:
            parts["members"] = tuple(cls.from_json(m) for m in parts["members"])
        if "content" in parts:
            parts["content"] = cls.from_json(parts["content"])
        return cls(kind, **parts)


@dataclass
class GrammarModel:
    """A whole grammar. The first rule is the start rule."""

    name: str
    rules: dict[str, Expr]
    extras: list[Expr] = field(default_factory=list)
    conflicts: list[list[str]] = field(default_factory=list)
    precedences: list[list[Expr]] = field(default_factory=list)
    externals: list[Expr] = field(default_factory=list)
    inline: list[str] = field(default_factory=list)
    supertypes: list[str] = field(default_factory=list)
    word: str | None = None
    reserved: dict[str, list[Expr]] = field(default_factory=dict)
    sites: dict[str, Site] = field(default_factory=dict, compare=False, repr=False)

    @property
    def start(self) -> str:
        if not self.rules:
            raise GrammarError(f"grammar {self.name} has no rules")
        return next(iter(self.rules))

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"$schema": SCHEMA_URL, "name": self.name}
        if self.word:
            out["word"] = self.word
        out["rules"] = {k: v.to_json() for k, v in self.rules.items()}
        out["extras"] = [e.to_json() for e in self.extras]
        out["conflicts"] = self.conflicts
        out["precedences"] = [[e.to_json() for e in level] for level in self.precedences]
        out["externals"] = [e.to_json() for e in self.externals]
        out["inline"], out["supertypes"] = self.inline, self.supertypes
        if self.reserved:
            out["reserved"] = {k: [e.to_json() for e in v] for k, v in self.reserved.items()}
        return out

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> GrammarModel:
        known = {f.name for f in fields(cls)} - {"sites"} | {"$schema"}
        if extra := set(data) - known:
            raise GrammarError(f"a grammar does not take {sorted(extra)}")
        many = lambda key: [Expr.from_json(e) for e in data.get(key, [])]
        return cls(
            data["name"],
            {k: Expr.from_json(v) for k, v in data["rules"].items()},
            many("extras"),
            [list(c) for c in data.get("conflicts", [])],
            [[Expr.from_json(e) for e in level] for level in data.get("precedences", [])],
            many("externals"),
            list(data.get("inline", [])),
            list(data.get("supertypes", [])),
            data.get("word"),
            {k: [Expr.from_json(e) for e in v] for k, v in data.get("reserved", {}).items()},
        )

    def emit_json(self, path: str | Path) -> Path:
        path = Path(path)
        path.write_text(json.dumps(self.to_json(), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        return path

    @classmethod
    def load(cls, path: str | Path) -> GrammarModel:
        return cls.from_json(json.loads(Path(path).read_text(encoding="utf-8")))
