"""Value maps: which node kinds hold which scalars, which kinds wrap text, which are arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .schema import NodeSchema

SCALARS = ("int", "float", "bool", "str", "null")
#: Which labels feed a target type.
FEEDS = {"int": ("int",), "float": ("float", "int"), "bool": ("bool",), "str": ("str",)}


@dataclass(frozen=True)
class ValueMap:
    scalars: dict[str, str] = field(default_factory=dict)
    wrappers: dict[str, str] = field(default_factory=dict)
    arrays: dict[str, list[str]] = field(default_factory=dict)
    format_version: int = 1

    def to_json(self) -> dict:
        return {"format_version": self.format_version, "scalars": self.scalars, "wrappers": self.wrappers, "arrays": self.arrays}

    @classmethod
    def of(cls, data: dict | ValueMap) -> ValueMap:
        if isinstance(data, ValueMap):
            return data
        if bad := set(data.get("scalars", {}).values()) - set(SCALARS):
            raise ValueError(f"unknown scalar labels {sorted(bad)}")
        return cls(dict(data.get("scalars", {})), dict(data.get("wrappers", {})), {k: list(v) for k, v in data.get("arrays", {}).items()}, data.get("format_version", 1))

    def scalar_kinds_for(self, target: str) -> list[str]:
        return sorted(k for k, label in self.scalars.items() if label in FEEDS.get(target, ()))

    def wrapper_kinds_for(self, target: str) -> list[str]:
        return sorted(self.wrappers) if target == "str" else []

    def array_kinds_for(self, element: str) -> list[str]:
        fits = {*self.scalar_kinds_for(element), *self.wrapper_kinds_for(element)}
        return sorted(k for k, items in self.arrays.items() if fits & set(items) or element == "nested")


# The JSON family's kinds.
JSON_VALUE_MAP = ValueMap(
    {"number": "int", "true": "bool", "false": "bool", "null": "null"},
    {"string": "string_content"},
    {"array": ["object", "array", "number", "string", "true", "false", "null"]},
)
JSON_KINDS = frozenset(("document", "object", "array", "pair", "string", "string_content", "number", "true", "false", "null"))
#: All of them but null: a grammar with these is taken for JSON.
JSON_CORE = JSON_KINDS - {"null"}
#: Inner leaves of wrappers, the most telling name first.
LEAF_NAMES = ("string_content", "content", "text")


def looks_like_json(schema: NodeSchema | None) -> bool:
    return schema is not None and JSON_CORE <= schema.named_kinds


def inner_leaf(schema: NodeSchema, kind: str) -> str | None:
    """The leaf that holds a wrapper's text: a kind with positional leaves below it and no fields."""
    entry = schema.get(kind, True)
    if entry is None or entry.fields or entry.children is None or schema.is_supertype(kind):
        return None
    leaves = [r.type for r in schema.expand(entry.children.types) if r.named and (e := schema.get(r.type, True)) and e.children is None and not e.fields]
    return min(leaves, key=lambda k: (LEAF_NAMES.index(k) if k in LEAF_NAMES else len(LEAF_NAMES), k), default=None)


def _words(kind: str) -> set[str]:
    return set(re.split(r"[_\W]+", kind.lower()))


#: Draft families in the order they are tried: (words in a kind's name, label).
_DRAFT = (
    ({"bool", "boolean", "true", "false"}, "bool"),
    ({"int", "integer", "number", "decimal", "digits"}, "int"),
    ({"float", "double", "real"}, "float"),
    ({"null", "nil", "none", "undefined"}, "null"),
)
_ARRAYS = {"array", "list", "sequence", "tuple"}


def propose_value_map(schema: NodeSchema) -> ValueMap:
    """A draft from kind names and shapes, to be reviewed by whoever uses it."""
    scalars: dict[str, str] = {}
    wrappers: dict[str, str] = {}
    arrays: dict[str, list[str]] = {}
    for kind in sorted(schema.named_kinds):
        entry = schema.get(kind, True)
        if schema.is_supertype(kind):
            continue
        leaf = not entry.fields and entry.children is None
        if _words(kind) & _ARRAYS and entry.children is not None:
            arrays[kind] = sorted(r.type for r in schema.expand(entry.children.types) if r.named)
            continue
        label = next((label for names, label in _DRAFT if _words(kind) & names), None)
        if label and (leaf or not entry.fields):
            scalars[kind] = label
        elif leaf:
            scalars[kind] = "str"
        elif inner := inner_leaf(schema, kind):
            wrappers[kind] = inner
    return ValueMap(scalars, wrappers, arrays)
