"""Models: an annotated class is the query and the row type."""

from __future__ import annotations

import sys
import types
import typing
from dataclasses import dataclass
from typing import Annotated, Any, Union, get_args, get_origin, get_type_hints

from pyspark.sql import types as T

from .errors import ShapeError

GAP = "..."
ANCHOR = "_anchor"
_MISSING = object()


class M:
    """An ancestor path of node kinds, the last one the anchor. ``...`` is a gap of any depth; a tuple is a choice."""

    def __init__(self, *path: Any, record: bool = False, record_pair: str | None = None):
        steps: list[Any] = []
        for step in path:
            if step is Ellipsis or step == GAP:
                steps.append(GAP)
            elif isinstance(step, str):
                steps.append((step,))
            elif isinstance(step, (tuple, list)) and step and all(isinstance(k, str) for k in step):
                steps.append(tuple(step))
            else:
                raise TypeError(f"a path step is a kind, a tuple of kinds or ...: {step!r}")
        if not any(s != GAP for s in steps):
            raise ShapeError("a path needs at least one kind")
        if steps[0] == GAP or steps[-1] == GAP:
            raise ShapeError("a gap can neither begin nor end a path")
        self.steps, self.record, self.record_pair = tuple(steps), record, record_pair

    @property
    def anchors(self) -> tuple[str, ...]:
        return self.steps[-1]

    def __repr__(self):
        return "M(" + ", ".join("..." if s == GAP else "|".join(s) for s in self.steps) + ")"


@dataclass(frozen=True)
class _Capture:
    field: str | None = None


@dataclass(frozen=True)
class _CaptureKind:
    kind: str


@dataclass(frozen=True)
class _Meta:
    capture: str = ANCHOR


@dataclass(frozen=True)
class _Derived:
    value: Any = _MISSING


def capture(field: str | None = None) -> Any:
    """Binds to a field of the node (or key of the record); without a name, the attribute's own."""
    return _Capture(field)


def capture_kind(kind: str) -> Any:
    """Binds to a child by its kind."""
    return _CaptureKind(kind)


def source_meta(capture: str = ANCHOR) -> Any:
    """The anchor's place: its line for int, else a Span."""
    return _Meta(capture)


def derived(value: Any = _MISSING) -> Any:
    """A constant that takes no part in the query."""
    return _Derived(value)


class NodeKind:
    def __init__(self, *kinds: str | tuple[str, ...]):
        self.kinds = tuple(k for given in kinds for k in ((given,) if isinstance(given, str) else given))


@dataclass(frozen=True)
class Matches:
    regex: str


@dataclass(frozen=True)
class Eq:
    value: str


class AnyOf:
    def __init__(self, *values: str):
        self.values = tuple(values)


class Unescaped:
    """Decode the escapes of a string literal."""


@dataclass(frozen=True)
class RawQuery:
    source: str


class Span:
    """A place in the text: 1-based lines, 0-based byte columns."""

    FIELDS = ("line", "column", "end_line", "end_column", "start_byte", "end_byte", "text")
    TYPE = T.StructType([*(T.StructField(n, T.IntegerType()) for n in FIELDS[:-1]), T.StructField("text", T.StringType())])

    def __init__(self, **parts: Any):
        for name in self.FIELDS:
            setattr(self, name, parts.get(name))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Span) and all(getattr(self, n) == getattr(other, n) for n in self.FIELDS)

    def __repr__(self):
        return "Span(" + ", ".join(f"{n}={getattr(self, n)!r}" for n in self.FIELDS) + ")"


SCALAR_TYPES = {str: "str", int: "int", float: "float", bool: "bool"}
SPARK_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class Binding:
    """How one attribute is filled."""

    name: str
    source: str  # field, kind, key, meta, derived
    key: str
    targets: tuple[str, ...]  # scalar types, tried in order; ("span",) for places
    is_list: bool = False
    optional: bool = False
    default: Any = _MISSING
    kinds: tuple[str, ...] = ()
    predicates: tuple[Any, ...] = ()
    unescape: bool = False
    nested: type | None = None
    explicit: bool = False

    @property
    def has_default(self) -> bool:
        return self.default is not _MISSING

    @property
    def required(self) -> bool:
        return not (self.optional or self.has_default or self.is_list)

    def spark_type(self) -> T.DataType:
        if self.nested is not None:
            inner: T.DataType = self.nested.struct_type()
        elif self.targets == ("span",):
            inner = Span.TYPE
        else:
            inner = SPARK_TYPES["float" if "float" in self.targets else self.targets[0]]
        return T.ArrayType(inner) if self.is_list else inner


@dataclass(frozen=True)
class ExtractSpec:
    model: type
    path: M | None
    raw: str | None
    bindings: tuple[Binding, ...]

    @property
    def record(self) -> bool:
        return self.path is not None and self.path.record

    @property
    def captures(self) -> tuple[Binding, ...]:
        return tuple(b for b in self.bindings if b.source in ("field", "kind", "key"))


def _unwrapped(hint: Any) -> tuple[Any, list[Any], bool, bool]:
    """(inner type or union members, metadata, list, optional)."""
    extra: list[Any] = []
    optional = is_list = False
    while True:
        origin = get_origin(hint)
        if origin is Annotated:
            hint, *more = get_args(hint)
            extra += more
        elif origin in (Union, types.UnionType):
            arms = [a for a in get_args(hint) if a is not type(None)]
            optional |= len(arms) < len(get_args(hint))
            if len(arms) > 1:
                return arms, extra, is_list, optional
            hint = arms[0]
        elif origin in (list, typing.List) and not is_list:
            is_list, hint = True, get_args(hint)[0]
        else:
            return hint, extra, is_list, optional


def _binding(cls: type, name: str, hint: Any, record: bool) -> Binding:
    mark = cls.__dict__.get(name, _MISSING)
    if mark is _MISSING:
        mark = next((base.__dict__[name] for base in cls.__mro__ if name in base.__dict__), _MISSING)
    inner, extra, is_list, optional = _unwrapped(hint)
    kinds = tuple(k for e in extra if isinstance(e, NodeKind) for k in e.kinds)
    tests = tuple(e for e in extra if isinstance(e, (Matches, Eq, AnyOf)))
    nested = inner if isinstance(inner, type) and issubclass(inner, OutputModel) else None
    arms = inner if isinstance(inner, list) else [inner]
    if nested:
        targets: tuple[str, ...] = ("nested",)
    elif inner is Span:
        targets = ("span",)
    elif all(a in SCALAR_TYPES for a in arms):
        targets = tuple(SCALAR_TYPES[a] for a in arms)
    else:
        raise ShapeError(f"{cls.__name__}.{name}: no column type for {hint!r}")
    shared = dict(targets=targets, is_list=is_list, optional=optional, kinds=kinds, predicates=tests, nested=nested, unescape=any(e is Unescaped or isinstance(e, Unescaped) for e in extra))
    if isinstance(mark, _Meta):
        return Binding(name, "meta", mark.capture, **shared)
    if isinstance(mark, _Derived):
        return Binding(name, "derived", name, default=mark.value, **shared)
    if isinstance(mark, _CaptureKind):
        source, key, default, explicit = "kind", mark.kind, _MISSING, True
    elif isinstance(mark, _Capture):
        source, key, default, explicit = "key" if record else "field", mark.field or name, _MISSING, True
    else:
        source, key, default, explicit = "key" if record else "field", name, mark, False
    if nested and not record:
        raise ShapeError(f"{cls.__name__}.{name}: nested models need record mode")
    return Binding(name, source, key, default=default, explicit=explicit, **shared)


def _spec(cls: type, scope: dict[str, Any]) -> ExtractSpec | None:
    path = next((b.__dict__["__match__"] for b in cls.__mro__ if "__match__" in b.__dict__), None)
    raw = next((b.__dict__["__raw_query__"] for b in cls.__mro__ if "__raw_query__" in b.__dict__), None)
    if path is not None and raw is not None:
        raise ShapeError(f"{cls.__name__} has both __match__ and __raw_query__")
    if path is None and raw is None:
        return None
    try:
        hints = get_type_hints(cls, localns=scope, include_extras=True)
    except Exception as error:
        raise ShapeError(f"{cls.__name__}: annotation cannot be resolved: {error}") from error
    record = path is not None and path.record
    bindings = tuple(_binding(cls, n, h, record) for n, h in hints.items() if not n.startswith("__"))
    return ExtractSpec(cls, path, raw.source if isinstance(raw, RawQuery) else raw, bindings)


class OutputModel:
    """Base of models. Attributes say what is captured; instances are rows."""

    __spec__: ExtractSpec | None = None

    def __init_subclass__(cls, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        frame = sys._getframe(1)
        cls.__spec__ = _spec(cls, {**frame.f_locals, cls.__name__: cls})
        cls.__site__ = f"{frame.f_code.co_filename}:{frame.f_lineno}"

    def __init__(self, **values: Any):
        for binding in self.spec().bindings:
            setattr(self, binding.name, values.get(binding.name))

    @classmethod
    def spec(cls) -> ExtractSpec:
        if cls.__spec__ is None:
            raise ShapeError(f"{cls.__name__} has neither __match__ nor __raw_query__")
        return cls.__spec__

    @classmethod
    def struct_type(cls) -> T.StructType:
        return T.StructType([T.StructField(b.name, b.spark_type()) for b in cls.spec().bindings])

    @classmethod
    def of_row(cls, row: Any) -> OutputModel:
        values = {}
        for b in cls.spec().bindings:
            value = row[b.name]
            if b.nested and value is not None:
                value = [b.nested.of_row(v) for v in value] if b.is_list else b.nested.of_row(value)
            elif b.targets == ("span",) and value is not None:
                value = Span(**value.asDict())
            values[b.name] = value
        return cls(**values)

    def model_dump(self) -> dict[str, Any]:
        def plain(v: Any) -> Any:
            return v.model_dump() if isinstance(v, OutputModel) else [plain(x) for x in v] if isinstance(v, list) else v

        return {b.name: plain(getattr(self, b.name)) for b in self.spec().bindings}

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and self.model_dump() == other.model_dump()

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.model_dump().items())})"

    # The one-line forms.

    @classmethod
    def validate_with(cls, language: Any) -> list[str]:
        """Runs all checks against a language; the warnings."""
        from .language import language_for

        return language_for(language).extractor(cls).warnings

    @classmethod
    def extract(cls, source: Any, *, language: Any, strict: bool = True) -> Any:
        """Rows of a text as a list, or of a DataFrame (doc_id, text) as a DataFrame."""
        from .language import language_for

        return language_for(language).extractor(cls, strict=strict).extract(source)

    @classmethod
    def compiled_source(cls, *, language: Any = None) -> str:
        from .language import language_for
        from .plans.explain import pattern_text

        if language is not None:
            return language_for(language).extractor(cls).query_source
        return pattern_text(cls.spec())
