"""Errors, from the most general to the particular."""

from __future__ import annotations


class SyntaxFrameError(Exception):
    """Base of all errors of this package."""


class SchemaCheckError(SyntaxFrameError):
    """A model or query does not fit the grammar's node schema."""

    def __init__(self, message: str, *, schema_entry: object = None, model: type | None = None):
        super().__init__(message)
        self.schema_entry, self.model = schema_entry, model


class ShapeError(SyntaxFrameError):
    """A declaration is malformed, or the grammar has no shape that it could take."""


class QueryBuildError(SyntaxFrameError):
    """A tree query cannot be built."""


class AmbiguousCaptureError(SyntaxFrameError):
    """Several nodes were captured for a field that holds one."""


class ExtractionError(SyntaxFrameError):
    """Rows that could not be made; ``failures`` lists them (or the first of ``total``), ``into`` is the model."""

    def __init__(self, failures: list, into: type | None = None, total: int | None = None):
        self.failures, self.into, self.total = failures, into, len(failures) if total is None else total
        shown = "; ".join(str(f) for f in failures[:3])
        super().__init__(f"{self.total} rows of {getattr(into, '__name__', 'the model')} failed: {shown}")


class BundleError(SyntaxFrameError):
    """A grammar bundle is incomplete or of an unknown format."""


class WasmRuntimeUnavailableError(BundleError):
    """A bundle holds a WebAssembly artifact; there is no runtime for it here."""


class GrammarError(SyntaxFrameError):
    """A grammar is malformed."""


class GrammarCheckError(GrammarError):
    """Static checks found errors; ``issues`` lists them."""

    def __init__(self, issues: list):
        self.issues = issues
        super().__init__("\n".join(map(str, issues)))


class PipelineError(SyntaxFrameError):
    """Building a grammar failed."""


class GenerateError(PipelineError):
    """Parse tables could not be made."""


class CompileError(PipelineError):
    """An external scanner is missing or unusable."""
