"""All that grammar authors need, in one place."""

from ..operators.corpus import Case, Corpus, CorpusResult, corpus_case
from ..operators.render import render, render_compact
from .accessors import generate_typed_api, write_typed_api
from .build import (
    BuildResult,
    ExternalScannerRequiredError,
    build,
    build_builder,
    build_community_bundle,
    build_from_source_dir,
    build_loop,
    debug_states,
    derive_schema_for_dir,
    write_bundle,
)
from .conflicts import Conflict, GrammarConflictError, parse_conflict_json
from .derive import derive_schema
from .dsl import (
    B,
    Grammar,
    Ladder,
    alias,
    blank,
    choice,
    field,
    immediate_token,
    opt,
    pattern,
    prec,
    prec_dynamic,
    prec_left,
    prec_right,
    ref,
    repeat,
    repeat1,
    reserved,
    seq,
    tok,
    token,
)
from .expressions import expression, semantic_smoke
from .ir import Expr, GrammarModel
from .lint import Issue, assert_clean, errors, run_checks, warnings
from .rules import External, Extra, Hidden, Inline, Pattern, R, Rule, Supertype, Token, Word, assemble, module_rules
from .scanners import SCANNERS, scanner_for

__all__ = [
    "B", "BuildResult", "Case", "Conflict", "Corpus", "CorpusResult", "Expr", "External", "ExternalScannerRequiredError", "Extra", "Grammar",
    "GrammarConflictError", "GrammarModel", "Hidden", "Inline", "Issue", "Ladder", "Pattern", "R", "Rule", "SCANNERS", "Supertype", "Token",
    "Word", "alias", "assemble", "assert_clean", "blank", "build", "build_builder", "build_community_bundle", "build_from_source_dir",
    "build_loop", "choice", "corpus_case", "debug_states", "derive_schema", "derive_schema_for_dir", "errors", "expression", "field",
    "generate_typed_api", "immediate_token", "module_rules", "opt", "parse_conflict_json", "pattern", "prec", "prec_dynamic", "prec_left",
    "prec_right", "ref", "render", "render_compact", "repeat", "repeat1", "reserved", "run_checks", "scanner_for", "semantic_smoke", "seq",
    "tok", "token", "warnings", "write_bundle", "write_typed_api",
]
