"""syntaxframe: typed extraction from structured text, planned as ordinary DataFrame queries."""

from .errors import (
    AmbiguousCaptureError,
    BundleError,
    ExtractionError,
    QueryBuildError,
    SchemaCheckError,
    ShapeError,
    SyntaxFrameError,
    WasmRuntimeUnavailableError,
)
from .language import Extractor, Language, MatchFailure, language_for
from .model import AnyOf, Eq, M, Matches, NodeKind, OutputModel, RawQuery, Span, Unescaped, capture, capture_kind, derived, source_meta
from .schema import ChildInfo, NodeSchema, NodeTypeInfo, NodeTypeRef
from .sources.bundles import load_bundle
from .valuemap import JSON_VALUE_MAP, ValueMap, propose_value_map

__all__ = [
    "JSON_VALUE_MAP", "AmbiguousCaptureError", "AnyOf", "BundleError", "ChildInfo", "Eq", "ExtractionError", "Extractor", "Language", "M",
    "MatchFailure", "Matches", "NodeKind", "NodeSchema", "NodeTypeInfo", "NodeTypeRef", "OutputModel", "QueryBuildError", "RawQuery",
    "SchemaCheckError", "ShapeError", "Span", "SyntaxFrameError", "Unescaped", "ValueMap", "WasmRuntimeUnavailableError", "capture",
    "capture_kind", "derived", "language_for", "load_bundle", "propose_value_map", "source_meta",
]
