"""Checks of a model against a grammar, all before any Spark job, and what they find out for the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import QueryBuildError, SchemaCheckError, ShapeError
from ..model import GAP, Binding, ExtractSpec
from ..schema import NodeSchema
from ..valuemap import JSON_VALUE_MAP, ValueMap, inner_leaf, looks_like_json, propose_value_map


@dataclass
class Checked:
    """A model that fits: per binding the kinds that may be captured, and the shapes of a record."""

    spec: ExtractSpec
    values: ValueMap | None
    kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pair_kinds: tuple[str, ...] = ()
    key_leaves: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nested: dict[str, Checked] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Analyzer:
    def __init__(self, schema: NodeSchema | None, values: ValueMap | None):
        self.schema, self.declared = schema, values
        self._draft: ValueMap | None = None

    def resolve_values(self, record: bool) -> ValueMap | None:
        """An explicit map, else the JSON one where the grammar is like JSON or unknown; a record needs one."""
        if self.declared is not None:
            return self.declared
        if self.schema is None or looks_like_json(self.schema):
            return JSON_VALUE_MAP
        if record:
            raise ShapeError("record mode over a grammar that is not like JSON needs a value map (propose_value_map drafts one)")
        return None

    def draft(self) -> ValueMap | None:
        if self._draft is None and self.schema is not None:
            self._draft = propose_value_map(self.schema)
        return self._draft

    # Which kinds feed a type.

    def feeds(self, kind: str, target: str, values: ValueMap | None) -> bool:
        """May this kind's text become this type? The committed map decides kinds that it names, the draft the others."""
        if target == "str" and self.schema is not None:
            # Any text will do: a leaf or a wrapper, whatever scalar it may hold besides.
            return self.is_text(kind) or (values is not None and (kind in values.wrappers or values.scalars.get(kind) == "str"))
        for held in (values, self.draft()):
            if held is not None and kind in held.scalars:
                return kind in held.scalar_kinds_for(target)
        return self.schema is None

    def is_text(self, kind: str) -> bool:
        """A leaf, or a wrapper one level deep; never a supertype or a kind with fields."""
        entry = self.schema.get(kind)
        if entry is None or entry.subtypes or entry.fields:
            return False
        return entry.children is None or inner_leaf(self.schema, kind) is not None

    # The checks.

    def check(self, spec: ExtractSpec) -> Checked:
        out = Checked(spec, self.resolve_values(spec.record))
        if self.schema is not None and spec.path is not None:
            self._path(spec)
        if spec.raw is not None:
            self._raw(spec, out)
        elif spec.record:
            self._record(spec, out)
        else:
            self._fields(spec, out)
        for b in spec.bindings:
            if b.source == "derived" and not b.has_default:
                out.warnings.append(f"{spec.model.__name__}.{b.name} is derived without a value: it stays empty")
            if b.nested is not None and b.source == "key":
                inner = b.nested.spec()
                out.nested[b.name] = self._nested(inner)
        return out

    def _nested(self, spec: ExtractSpec) -> Checked:
        if spec.path is None or not spec.record:
            raise ShapeError(f"{spec.model.__name__}: a nested model is in record mode")
        return self.check(spec)

    def _site(self, spec: ExtractSpec) -> str:
        return f"{spec.model.__name__} ({getattr(spec.model, '__site__', '?')})"

    def _fail(self, spec: ExtractSpec, text: str, entry=None) -> None:
        raise SchemaCheckError(f"{self._site(spec)}: {text}", schema_entry=entry, model=spec.model)

    def _path(self, spec: ExtractSpec) -> None:
        schema, before, gap = self.schema, None, False
        for step in spec.path.steps:
            if step == GAP:
                gap = True
                continue
            for kind in step:
                if not schema.can_occur(kind):
                    self._fail(spec, f"the grammar has no kind {kind!r}")
            if before is not None:
                # Each alternative needs some alternative above it, and some below.
                reach = schema.is_possible_descendant if gap else schema.is_possible_descent
                for kind in step:
                    if not any(reach(up, kind) for up in before):
                        self._fail(spec, f"{kind!r} cannot stand {'below' if gap else 'directly in'} {' or '.join(before)}", schema.get(before[0]))
            before, gap = step, False

    def _typed(self, spec: ExtractSpec, b: Binding, kinds: list[str], out: Checked) -> None:
        """At least one kind must give the type; explicit kinds must all."""
        if b.targets[0] in ("span", "nested"):
            return
        if self.schema is not None and b.kinds:
            for kind in b.kinds:
                if not self.schema.can_occur(kind):
                    self._fail(spec, f"{b.name}: the grammar has no kind {kind!r}")
                if not any(self.feeds(kind, t, out.values) for t in b.targets):
                    self._fail(spec, f"{b.name}: {kind!r} does not hold {' or '.join(b.targets)}", self.schema.get(kind))
            kinds = list(b.kinds)
        fits = [k for k in kinds if any(self.feeds(k, t, out.values) for t in b.targets)]
        if kinds and not fits and not b.kinds and not (b.targets == ("str",) and spec.raw is None and not spec.record):
            self._fail(spec, f"{b.name}: none of {sorted(kinds)} holds {' or '.join(b.targets)}")
        if b.unescape and kinds:
            wraps = {**(out.values.wrappers if out.values else {}), **(self.draft().wrappers if self.draft() else {})}
            if not any(k in wraps for k in kinds):
                self._fail(spec, f"{b.name}: escapes need a string kind, not {sorted(kinds)}")
        if b.kinds:
            out.kinds[b.name] = b.kinds
        elif len(fits) == 1 and not spec.record:
            out.kinds[b.name] = (fits[0],)

    def _fields(self, spec: ExtractSpec, out: Checked) -> None:
        for b in spec.captures:
            if self.schema is None:
                if b.kinds:
                    out.kinds[b.name] = b.kinds
                continue
            found: set[str] = set()
            for anchor in spec.path.anchors:
                if b.source == "field":
                    if not self.schema.has_field(anchor, b.key):
                        self._fail(spec, f"{anchor!r} has no field {b.key!r} ({b.name})", self.schema.get(anchor))
                    found |= {r.type for r in self.schema.expand(self.schema.field_types(anchor, b.key)) if r.named}
                else:
                    if b.key in self.schema.possible_children(anchor):
                        found.add(b.key)
            if b.source == "kind" and not found:
                self._fail(spec, f"{b.key!r} cannot stand directly in {' or '.join(spec.path.anchors)} ({b.name})")
            if b.kinds and not found & set(b.kinds):
                self._fail(spec, f"{b.name}: {sorted(b.kinds)} are not among {sorted(found)}")
            self._typed(spec, b, sorted(found), out)
        self._order(spec)

    def _order(self, spec: ExtractSpec) -> None:
        """Two bindings of one single child cannot both be filled."""
        for b in spec.captures:
            twins = [o for o in spec.captures if o is not b and o.source == b.source == "field" and o.key == b.key and o.required and b.required]
            for anchor in spec.path.anchors if self.schema is not None and twins else ():
                entry = self.schema.get(anchor)
                if entry and entry.fields and not entry.fields[b.key].multiple:
                    raise QueryBuildError(f"{self._site(spec)}: field {b.key!r} of {anchor!r} holds one child, {b.name} and {twins[0].name} want two")

    def _record(self, spec: ExtractSpec, out: Checked) -> None:
        schema, pin = self.schema, spec.path.record_pair
        if schema is None:
            out.pair_kinds = (pin or "pair",)
            out.key_leaves = {"string": ("string_content",)}
        else:
            found = sorted({k for a in spec.path.anchors for k in schema.possible_children(a) if schema.has_field(k, "key") and schema.has_field(k, "value")})
            if pin is not None and pin not in found:
                raise ShapeError(f"{self._site(spec)}: {pin!r} is no pair kind of {' or '.join(spec.path.anchors)} (those are {found})")
            if not found:
                raise ShapeError(f"{self._site(spec)}: {' or '.join(spec.path.anchors)} has no child with a key and a value")
            if len(found) > 1 and pin is None:
                raise ShapeError(f"{self._site(spec)}: several pair kinds {found}; choose one with record_pair=")
            out.pair_kinds = (pin or found[0],)
            for pair in out.pair_kinds:
                for ref in schema.expand(schema.field_types(pair, "key")):
                    if leaf := inner_leaf(schema, ref.type):
                        out.key_leaves[ref.type] = (leaf,)
        values = out.values
        for b in spec.captures:
            if b.nested is not None or b.kinds:
                if b.kinds:
                    out.kinds[b.name] = b.kinds
                continue
            kinds = {k for t in b.targets for k in (*values.scalar_kinds_for(t), *values.wrapper_kinds_for(t))}
            if b.unescape:
                kinds = set(values.wrappers)
            if schema is not None:
                kinds &= schema.named_kinds
            if b.is_list:
                arrays = [k for k, items in values.arrays.items() if set(items) & kinds and (schema is None or schema.can_occur(k))]
                if not arrays:
                    raise ShapeError(f"{self._site(spec)}: no array kind holds {' or '.join(b.targets)} ({b.name})")
            elif not kinds:
                raise ShapeError(f"{self._site(spec)}: no value kind holds {' or '.join(b.targets)} ({b.name})")
            out.kinds[b.name] = tuple(sorted(kinds))
            if schema is not None and not b.is_list:
                possible = {r.type for p in out.pair_kinds for r in schema.expand(schema.field_types(p, "value"))}
                if not possible & kinds:
                    self._fail(spec, f"{b.name}: values are {sorted(possible)}, none holds {' or '.join(b.targets)}")

    def _raw(self, spec: ExtractSpec, out: Checked) -> None:
        from .raw import parse_query

        query = parse_query(spec.raw)
        names = {n for p in query for n in p.capture_names()}
        for b in spec.captures:
            if b.key not in names and b.name not in names and b.required:
                self._fail(spec, f"the query captures no {b.key!r} (it has {sorted(names)})")
            if self.schema is not None and b.explicit and b.source == "field" and b.key not in names:
                if not any(self.schema.has_field(k, b.key) for k in self.schema.named_kinds):
                    self._fail(spec, f"no kind has a field {b.key!r}")
        if self.schema is not None:
            for pattern in query:
                for kind in pattern.kinds():
                    if kind not in self.schema.kinds:
                        self._fail(spec, f"the grammar has no kind {kind!r}")

