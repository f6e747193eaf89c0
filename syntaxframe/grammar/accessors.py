"""Typed accessors generated from a node schema: source text of a module with one class a kind."""

from __future__ import annotations

import keyword
import re
from pathlib import Path

from ..schema import ChildInfo, NodeSchema


def class_name(kind: str) -> str:
    name = "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", kind) if p)
    return f"Kind{name}" if not name or name[0].isdigit() or keyword.iskeyword(name) else name


def attribute_name(field: str) -> str:
    """A field's property; names that the base class has, and keywords, get a prefix."""
    return f"field_{field}" if field in ("node", "text", "kind", "source", "wrap", "children") or keyword.iskeyword(field) else field


HEAD = '''"""Typed access to the nodes of {name}. Generated from its node schema."""

from __future__ import annotations

from typing import Union


class Wrapped:
    """A node and the text it is from."""

    kind = ""

    def __init__(self, node, source):
        self.node, self.source = node, source

    @property
    def text(self):
        return self.source[self.node.start : self.node.end]

    def _field(self, name):
        return [wrap(n, self.source) for f, n in self.node.children if f == name]

    def children(self, kind=None):
        return [wrap(n, self.source) for _, n in self.node.children if n.named and (kind is None or n.kind == kind)]
'''


def _hint(schema: NodeSchema, info: ChildInfo) -> str:
    names = [class_name(r.type) for r in info.types if r.named] or ["Wrapped"]
    one = names[0] if len(names) == 1 else f"Union[{', '.join(names)}]"
    return f"list[{one}]" if info.multiple else one if info.required else f"{one} | None"


def generate_typed_api(schema: NodeSchema, module: str = "typed_api") -> str:
    out = [HEAD.format(name=module)]
    supers = [e for e in schema if e.subtypes and e.named]
    for entry in sorted((e for e in schema if e.named and not e.subtypes), key=lambda e: e.type):
        out.append(f"\n\nclass {class_name(entry.type)}(Wrapped):\n    kind = {entry.type!r}")
        for name, info in sorted((entry.fields or {}).items()):
            pick = f"self._field({name!r})" if info.multiple else f"next(iter(self._field({name!r})), None)"
            out.append(f"\n    @property\n    def {attribute_name(name)}(self) -> {_hint(schema, info)}:\n        return {pick}")
    done: set[str] = set()
    out.append("\n")
    while waiting := [e for e in supers if e.type not in done]:
        # A supertype comes after those that it names.
        ready = [e for e in waiting if all(r.type in done or not schema.is_supertype(r.type) for r in e.subtypes)] or waiting[:1]
        for e in sorted(ready, key=lambda e: e.type):
            names = ", ".join(class_name(r.type) if r.named else "Wrapped" for r in e.subtypes)
            out.append(f"\n{class_name(e.type)} = Union[{names}]")
            done.add(e.type)
    kinds = ", ".join(f"{e.type!r}: {class_name(e.type)}" for e in sorted(schema, key=lambda e: e.type) if e.named and not e.subtypes)
    out.append(f"\n\nKINDS = {{{kinds}}}\n\n\ndef wrap(node, source):\n    return KINDS.get(node.kind, Wrapped)(node, source)\n")
    return "".join(out)


def write_typed_api(schema: NodeSchema, path: str | Path) -> Path:
    path = Path(path)
    path.write_text(generate_typed_api(schema, path.stem), encoding="utf-8")
    return path
