"""Building grammars: checks, tables, schema, a cache by content, and bundles."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import sys
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..errors import CompileError, GenerateError, PipelineError
from ..schema import NodeSchema
from ..valuemap import ValueMap
from .conflicts import GrammarConflictError
from .derive import derive_schema
from .dsl import Grammar
from .ir import GrammarModel
from .lint import Issue, assert_clean
from .scanners import SCANNERS
from .tables import Tables, build_tables

#: Changes whenever tables of an older build are no longer fit.
ENGINE = "tables-4"
BUNDLE_FORMAT = 2


class ExternalScannerRequiredError(CompileError):
    """A grammar has external tokens and no scanner was given."""


@dataclass
class BuildResult:
    model: GrammarModel
    tables: Tables
    schema: NodeSchema
    scanner: str | None
    warnings: list[Issue]
    key: str
    cached: bool = False

    def language(self, value_map: ValueMap | None = None):
        from ..language import Language

        return Language(self.tables, self.schema, value_map, self.scanner)

    def package(self, directory: str | Path, *, value_map: ValueMap | None = None, typed_api: bool = False, **metadata: Any) -> Path:
        return write_bundle(self, directory, value_map=value_map, typed_api=typed_api, **metadata)


def grammar_hash(model: GrammarModel) -> str:
    return hashlib.sha256(json.dumps(model.to_json(), ensure_ascii=False).encode()).hexdigest()


def cache_key(model: GrammarModel, scanner: str | None) -> str:
    version = f"{sys.version_info.major}.{sys.version_info.minor}"
    return hashlib.sha256("\0".join([grammar_hash(model), model.name, scanner or "", ENGINE, version]).encode()).hexdigest()


def default_cache_dir() -> Path:
    """A folder in the user's own cache; builds run on the driver alone."""
    own = Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "syntaxframe"
    return Path(os.environ.get("SYNTAXFRAME_CACHE") or own)


def _trusted(entry: Path) -> bool:
    """Pickles are read only from folders that nobody else can write to."""
    return all(p.stat().st_uid == os.getuid() and not p.stat().st_mode & 0o022 for p in (entry, entry.parent))


def build(model: GrammarModel | Grammar, *, scanner: str | None = None, analyse: bool = True, cache_dir: str | Path | None = None) -> BuildResult:
    """Checks a grammar and makes its tables and schema, or takes them from the cache."""
    found: list[Issue] = []
    if isinstance(model, Grammar):
        found = assert_clean(model) if analyse else []
        model = model.build()
    elif analyse:
        found = assert_clean(model)
    if model.externals and scanner is None:
        raise ExternalScannerRequiredError(f"{model.name} has external tokens {[e.name or e.value for e in model.externals]} and no scanner")
    if scanner is not None and scanner not in SCANNERS:
        raise CompileError(f"no scanner {scanner!r}")
    key = cache_key(model, scanner)
    entry = Path(cache_dir or default_cache_dir()) / key
    warnings = [i for i in found if i.warning]
    try:
        if not _trusted(entry):
            raise OSError(f"{entry} can be written by others")
        tables = pickle.loads((entry / "tables.pickle").read_bytes())
        return BuildResult(model, tables, NodeSchema.from_node_types_json(entry / "node-schema.json"), scanner, warnings, key, True)
    except (OSError, pickle.UnpicklingError, AttributeError, EOFError):
        pass
    tables = build_tables(model)
    schema = derive_schema(model, tables)
    # Whoever is first puts the entry in place by one rename; another's is as good.
    entry.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=entry.parent) as work:
        (made := Path(work) / "entry").mkdir(mode=0o700)
        (made / "tables.pickle").write_bytes(pickle.dumps(tables))
        model.emit_json(made / "grammar.json")
        schema.write(made / "node-schema.json")
        try:
            made.rename(entry)
        except OSError:
            pass
    return BuildResult(model, tables, schema, scanner, warnings, key)


build_builder = build


def build_loop(g: Grammar, *, fix: Callable[[GrammarConflictError, Grammar], None], max_attempts: int = 10, **options: Any) -> Iterator[GrammarConflictError | BuildResult]:
    """Yields each conflict, lets ``fix`` change the grammar, and builds again; ends with the result."""
    for _ in range(max_attempts):
        try:
            yield build(g, **options)
            return
        except GrammarConflictError as error:
            yield error
            fix(error, g)
    raise RuntimeError(f"{g.name} still has conflicts after {max_attempts} attempts")


def debug_states(model: GrammarModel | Grammar, rule: str) -> str:
    """The parse states that hold productions of one rule."""
    from .tables import _Automaton, _Builder

    model = model.build() if isinstance(model, Grammar) else model
    if rule not in model.rules:
        raise PipelineError(f"no rule {rule!r}")
    builder = _Builder(model)
    builder.build(model.start)
    automaton = _Automaton(builder.productions, {**builder.terminals})
    lines = []
    for state, kernel in enumerate(automaton.kernels):
        held = [(at, dot) for at, dot in automaton.closure(kernel) if builder.productions[at].head == rule]
        for at, dot in held:
            steps = [s.symbol for s in builder.productions[at].steps]
            lines.append(f"state {state}: {rule} -> {' '.join([*steps[:dot], '•', *steps[dot:]])}")
    return "\n".join(lines)


def build_from_source_dir(source: str | Path, *, name: str | None = None, scanner: str | None = None, cache_dir: str | Path | None = None) -> BuildResult:
    """From a folder with grammar.json or src/grammar.json. The folder is only read, the checks are left out.

    Without a scanner's name, the one that a metadata.json beside the grammar names is taken, else the one registered scanner whose
    tokens are the grammar's externals. Scanners in C cannot be run; a grammar that only comes with one needs a name.
    """
    source = Path(source)
    found = next((p for p in (source / "grammar.json", source / "src/grammar.json") if p.exists()), None)
    if found is None:
        raise PipelineError(f"{source} has neither grammar.json nor src/grammar.json")
    model = GrammarModel.load(found)
    model.name = name or model.name
    return build(model, scanner=scanner or _scanner_beside(found, model), analyse=False, cache_dir=cache_dir)


def _scanner_beside(grammar: Path, model: GrammarModel) -> str | None:
    if not model.externals:
        return None
    for folder in (grammar.parent, grammar.parent.parent):
        if (folder / "metadata.json").exists():
            said = json.loads((folder / "metadata.json").read_text()).get("scanner")
            if said in SCANNERS:
                return said
    wanted = {e.name or str(e.value) for e in model.externals}
    fitting = [name for name, make in SCANNERS.items() if set(make().names) == wanted]
    if len(fitting) == 1:
        return fitting[0]
    if any((folder / f"scanner{end}").exists() for folder in (grammar.parent, grammar.parent.parent) for end in (".c", ".cc")):
        raise ExternalScannerRequiredError(f"{model.name} comes with a scanner in C, which cannot be run here; name one of {sorted(SCANNERS)}")
    return None


def derive_schema_for_dir(source: str | Path, *, name: str | None = None, out: str | Path | None = None, scanner: str | None = None) -> NodeSchema:
    schema = build_from_source_dir(source, name=name, scanner=scanner).schema
    if out is not None:
        schema.write(out)
    return schema


def build_community_bundle(source: str | Path, out: str | Path, name: str | None = None, scanner: str | None = None) -> Path:
    return write_bundle(build_from_source_dir(source, name=name, scanner=scanner), out)


def write_bundle(result: BuildResult, directory: str | Path, *, value_map: ValueMap | None = None, typed_api: bool = False, **metadata: Any) -> Path:
    """Grammar, tables, schema and metadata in one folder; tables are made again where the pickle does not fit."""
    directory = Path(directory)
    directory.mkdir(parents=True, exist_ok=True)
    result.model.emit_json(directory / "grammar.json")
    result.schema.write(directory / "node-schema.json")
    said = {"bundle_format": BUNDLE_FORMAT, "name": result.model.name, "artifact": "grammar.json", "schema": "node-schema.json", "abi": ENGINE, "toolchain": f"syntaxframe {ENGINE}"}
    if result.scanner:
        said["scanner"] = result.scanner
    if value_map is not None:
        said["value_map"] = value_map.to_json()
    (directory / "metadata.json").write_text(json.dumps({**said, **metadata}, indent=2) + "\n")
    if typed_api:
        from .accessors import write_typed_api

        write_typed_api(result.schema, directory / "typed_api.py")
    return directory


def main(argv: list[str] | None = None) -> int:
    """Schema of a grammar folder: <folder> [-o out.json] [-n name]."""
    args = list(sys.argv[1:] if argv is None else argv)
    options = {}
    for flag in ("-o", "-n"):
        if flag in args:
            at = args.index(flag)
            options[flag] = args[at + 1] if at + 1 < len(args) else None
            del args[at : at + 2]
    if len(args) != 1 or None in options.values():
        print(main.__doc__, file=sys.stderr)
        return 2
    schema = derive_schema_for_dir(args[0], name=options.get("-n"), out=options.get("-o"))
    if "-o" not in options:
        print(schema.to_json(), end="")
    return 0


__all__ = ["GenerateError", "build", "build_builder", "build_loop", "main"]
