"""Languages: a grammar's tables with its node schema and value map, and the extractors bound to them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .errors import ExtractionError
from .grammar import library
from .grammar.derive import derive_schema
from .grammar.dsl import Grammar
from .grammar.ir import GrammarModel
from .grammar.scanners import scanner_for
from .grammar.tables import Tables, build_tables
from .model import M, OutputModel
from .operators import ancestry
from .parse.rows import ARROW, COLUMNS, Wanted, parse_batches
from .parse.runtime import Node, Parser
from .parse.shapes import shapes_of
from .plans.analyze import Analyzer
from .plans.explain import pattern_text
from .plans.extract import FAILURE, captured_rows, field_rows, raw_rows, record_rows, wanted
from .plans.flat import Flat, flat, flat_nodes, serves
from .plans.raw import MATCHES, match_batches
from .plans.skip import any_can_give_rows, can_give_rows
from .schema import NodeSchema
from .sources.docs import spread
from .sources.staging import staged
from .valuemap import ValueMap


@lru_cache(maxsize=64)
def _tables(text: str) -> tuple[Tables, NodeSchema]:
    grammar = GrammarModel.from_json(json.loads(text))
    tables = build_tables(grammar)
    return tables, derive_schema(grammar, tables)


def schema_from(source: Any) -> NodeSchema | None:
    if source is None or isinstance(source, NodeSchema):
        return source
    return NodeSchema.from_list(source) if isinstance(source, (list, dict)) else NodeSchema.from_node_types_json(source)


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores before those that are taken (in any case) or come twice."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def _apart(docs: DataFrame, text_col: str, encoding: str = "utf-8") -> tuple[DataFrame, list[str], list[str]]:
    """docs with names of our own for all columns, ``text`` last; these names and the ones that they stand for. No name of a
    user's column can then meet one of a plan's. A column of bytes is read in the encoding; places of nodes count bytes of UTF-8."""
    kept = [c for c in docs.columns if c != text_col]
    own = [f"_doc{i}" for i in range(len(kept))]
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = column(text_col)
    if isinstance(docs.select(text).schema[0].dataType, BinaryType):
        text = F.decode(text, encoding)
    return docs.select(*(column(c).alias(o) for c, o in zip(kept, own)), text.alias("text")), own, kept


@dataclass(frozen=True)
class MatchFailure:
    """Why a row could not be made."""

    doc_id: Any
    pattern: str
    anchor: str
    line: int
    column: int
    start_byte: int
    end_byte: int
    errors: tuple[str, ...]

    def __str__(self):
        return f"{self.pattern} at line {self.line}: {'; '.join(self.errors)}"


class Language:
    """A grammar ready for parsing. Extractors are kept by (model, strict)."""

    def __init__(self, tables: Tables, schema: NodeSchema | None = None, value_map: ValueMap | None = None, scanner: str | None = None):
        self.tables, self.schema, self.value_map, self.scanner = tables, schema, value_map, scanner
        self._extractors: dict[tuple[type, bool], Extractor] = {}
        self._parser: Parser | None = None
        self._broadcast: tuple[Any, Any] | None = None

    # Ways to get one.

    @classmethod
    def load(cls, source: Any, schema: Any = None, value_map: Any = None, scanner: str | None = None) -> Language:
        """From a library name, a grammar (built or not), tables, a function that makes one, or a bundle directory.

        Without a schema the grammar's own is used; ``schema=False`` leaves it out.
        """
        values = None if value_map is None else ValueMap.of(value_map)
        if isinstance(source, Language):
            return source if schema is None and values is None else source.with_schema(source.schema if schema is None else schema_from(schema), values or source.value_map)
        if callable(source) and not isinstance(source, (Grammar, GrammarModel, Tables)):
            source = source()
        if isinstance(source, (str, Path)) and Path(source).is_dir():
            return cls.load_bundle(source, value_map)
        if isinstance(source, str) and source in library.BUILDERS:
            scanner = scanner or library.SCANNERS.get(source)
            source = library.grammar(source)
        if isinstance(source, Grammar):
            source = source.build()
        own = None
        if isinstance(source, GrammarModel):
            source, own = _tables(json.dumps(source.to_json(), sort_keys=False))
        if not isinstance(source, Tables):
            raise TypeError(f"no grammar: {source!r}")
        return cls(source, own if schema is None else schema_from(schema) if schema is not False else None, values, scanner)

    @classmethod
    def from_module(cls, module: Any, schema: Any = None, value_map: Any = None) -> Language:
        """From a module that has ``language``, ``grammar`` or ``build``."""
        maker = next((getattr(module, n) for n in ("language", "grammar", "build") if hasattr(module, n)), None)
        if maker is None:
            raise TypeError(f"{module!r} offers no grammar")
        return cls.load(maker, schema, value_map)

    @classmethod
    def load_bundle(cls, directory: str | Path, value_map: Any = None) -> Language:
        from .sources.bundles import load_bundle

        bundle = load_bundle(directory)
        values = ValueMap.of(value_map) if value_map is not None else bundle.value_map
        return cls(bundle.tables, bundle.schema, values, bundle.scanner)

    def with_schema(self, schema: NodeSchema | None, value_map: ValueMap | None = None) -> Language:
        return Language(self.tables, schema, value_map or self.value_map, self.scanner)

    @property
    def name(self) -> str:
        return self.tables.name

    @cached_property
    def flat(self) -> Flat | None:
        """The grammar as a list of tokens, if it is one; such nodes are made without a parser."""
        return flat(self.tables) if self.scanner is None else None

    # Parsing.

    def parser(self) -> Parser:
        if self._parser is None:
            self._parser = Parser(self.tables, scanner_for(self.scanner) if self.scanner else None)
        return self._parser

    def parse(self, source: str | bytes, encoding: str = "utf-8") -> Node:
        """The tree of a text, which remembers it and places from which reparse() can go on."""
        return self.parser().parse(source.decode(encoding) if isinstance(source, bytes) else source, keep=True)

    def reparse(self, old: Node, source: str | bytes, encoding: str = "utf-8") -> Node:
        """The tree of a changed text. Top-level nodes before the change, and those after it from the first place at which the parser
        stands as it did, are taken from the old tree (which must not be used any more); what is between is parsed. The
        result is that of parse()."""
        return self.parser().reparse(old, source.decode(encoding) if isinstance(source, bytes) else source)

    def _sent(self, spark: SparkSession):
        """The tables on the executors: a few hundred states at most, whatever the data."""
        context = spark.sparkContext
        if self._broadcast is None or self._broadcast[0] is not context:
            self._broadcast = context, context.broadcast((self.tables, self.scanner))
        return self._broadcast[1]

    def _parsed(self, docs: DataFrame, want: Wanted, carried: list[str]) -> DataFrame:
        """Node rows of docs(carried..., text)."""
        if serves(self.flat, want):
            return flat_nodes(spread(docs), self.flat, want, carried)
        sent = self._sent(docs.sparkSession)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema), COLUMNS])

        def run(batches):
            parser = _worker_parser(sent)
            return parse_batches(batches, parser.parse, want, carried, shapes_of(parser).find)

        return spread(docs).mapInArrow(run, schema)

    def nodes(self, docs: DataFrame, want: Wanted | None = None, text_col: str = "text", encoding: str = "utf-8") -> DataFrame:
        """The nodes relation of docs: its other columns, then COLUMNS of parse.rows. Null texts have no nodes.

        Columns of docs that are named like one of COLUMNS get an underscore before their names.
        """
        apart, own, kept = _apart(docs, text_col, encoding)
        nodes = self._parsed(apart, want or Wanted(), own)
        return nodes.toDF(*free_names(kept, [n for n, _ in ARROW]), *(n for n, _ in ARROW))

    def shared_nodes(self, docs: DataFrame, extractors: list[Extractor], text_col: str = "text") -> DataFrame:
        """The nodes that several extractors need, parsed once: written to the cluster's shared folder, from which each plan reads
        the columns and kinds that it wants."""
        useful = any_can_give_rows([e.checked for e in extractors], F.col(f"`{text_col}`"))
        return staged(self.nodes(docs if useful is None else docs.where(useful), shared_wanted(extractors), text_col), "nodes")

    def extractor(self, model: type[OutputModel], strict: bool = True) -> Extractor:
        key = model, strict
        if key not in self._extractors:
            self._extractors[key] = Extractor(self, model, strict)
        return self._extractors[key]


_parsers: dict[int, tuple[Any, Parser]] = {}


def _worker_parser(sent: Any) -> Parser:
    """One parser for each worker and grammar; its lexers are kept from task to task."""
    tables, scanner = value = sent.value
    held = _parsers.get(id(tables))
    if held is None or held[0] is not value[0]:
        _parsers[id(tables)] = held = tables, Parser(tables, scanner_for(scanner) if scanner else None)
    return held[1]


@lru_cache(maxsize=64)
def _named(name: str) -> Language:
    return Language.load(name)


def language_for(source: Any) -> Language:
    """A language from whatever names one; library grammars are made once."""
    return _named(source) if isinstance(source, str) and source in library.BUILDERS else Language.load(source)


class Extractor:
    """A model bound to a language: all checks are done when it is made."""

    def __init__(self, language: Language, model: type[OutputModel], strict: bool = True):
        self.language, self.model, self.strict = language, model, strict
        self.spec = model.spec()
        self.checked = Analyzer(language.schema, language.value_map).check(self.spec)
        self.warnings = self.checked.warnings

    @property
    def query_source(self) -> str:
        return pattern_text(self.spec, self.checked.kinds)

    def wanted(self) -> Wanted | None:
        return None if self.spec.raw is not None else wanted(self.checked)

    def rows(self, docs: DataFrame, text_col: str = "text", within: str | tuple[str, ...] | None = None, encoding: str = "utf-8") -> DataFrame:
        """All rows, good and failed: docs' columns, node_id, the model's columns and ``_failure``.

        Columns of docs that are named like one of the result get an underscore before their names. within: only anchors (of a
        raw query: matches) at or below nodes of these kinds. encoding: of a text column of bytes.
        """
        docs, own, kept = _apart(docs, text_col, encoding)
        scopes = None if within is None else frozenset((within,) if isinstance(within, str) else within)
        if self.spec.raw is None:
            useful = can_give_rows(self.checked, F.col("text"))
            nodes = self.language._parsed(docs if useful is None else docs.where(useful), self.wanted(), own)
            if scopes is not None:
                above = "/(?:" + "|".join(map(re.escape, sorted(scopes))) + ")(?:/|$)"
                nodes = nodes.where(F.col("kind").isin(*scopes) | F.col("path").rlike(above))
            out = self.from_nodes(nodes, own)
        else:
            sent, source = self.language._sent(docs.sparkSession), self.spec.raw
            declared = [n for b in self.spec.captures for n in (b.key, b.name)]
            schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema), MATCHES])
            matches = spread(docs).mapInArrow(lambda batches: match_batches(batches, _worker_parser(sent), source, declared, own, scopes), schema)
            out = raw_rows(matches, self.checked, own)
        result = out.columns[len(own) :]
        return out.toDF(*free_names(kept, result), *result)

    def from_nodes(self, nodes: DataFrame, carried: list[str] | None = None) -> DataFrame:
        """The same from a nodes relation made before (parse once, extract many models)."""
        carried = [c for c in nodes.columns if c not in {n for n, _ in ARROW}] if carried is None else carried
        return (record_rows if self.spec.record else field_rows)(nodes, self.checked, carried)

    def scoped(self, nodes: DataFrame, outer: DataFrame, doc: str = "doc_id") -> DataFrame:
        """Rows of the anchors in a nodes relation that are nodes of ``outer`` (doc, node_id, last_id) or stand below one."""
        return self.extract_nodes(ancestry.inside(nodes, outer, doc, itself=True))

    def of_records(self, nodes: DataFrame) -> DataFrame:
        """Rows of a record model for which each of the given nodes is a record itself, wherever it stands: its path is not looked at.
        The relation must have been parsed with the model's wanted(), its anchors being of the model's kinds."""
        free = replace(self.spec, path=M(self.spec.path.anchors, record=True))
        checked = replace(self.checked, spec=free)
        carried = [c for c in nodes.columns if c not in {n for n, _ in ARROW}]
        return self._finished(record_rows(nodes, checked, carried))

    def extract_nodes(self, nodes: DataFrame) -> DataFrame:
        return self._finished(self.from_nodes(nodes))

    def extract_captured(self, rows: DataFrame, carried: list[str]) -> DataFrame:
        """The same from rows of plans.captured."""
        return self._finished(captured_rows(rows, self.checked, carried))

    def _finished(self, rows: DataFrame) -> DataFrame:
        if not self.strict:
            return rows.where(F.col(FAILURE).isNull()).drop(FAILURE)
        # A failed row ends the job that meets it.
        said = F.concat(F.lit(f"{self.model.__name__}: "), F.array_join(F.col(FAILURE)["errors"], "; "), F.lit(" at line "), F.col(FAILURE)["line"].cast("string"))
        return rows.where(F.when(F.col(FAILURE).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(FAILURE)

    def failures(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The failed rows only."""
        rows = self.rows(docs, text_col)
        fields = rows.schema[FAILURE].dataType.fieldNames()
        kept = rows.columns[: len(docs.columns) - 1]
        failed = rows.where(F.col(FAILURE).isNotNull()).select(*(F.col(f"`{c}`") for c in kept), f"{FAILURE}.*")
        return failed.toDF(*free_names(kept, fields), *fields)

    def verified(self, docs: DataFrame, text_col: str = "text", most: int = 20) -> DataFrame:
        """Rows of docs whose texts all give good rows; otherwise one ExtractionError with the number of failed rows and the first
        ``most`` of them. The job that writes the rows counts the failed ones as it goes, so nothing is parsed or read a second time; only where
        some failed are these looked up in what was written."""
        seen = Observation()
        rows = staged(self.rows(docs, text_col).observe(seen, F.count_if(F.col(FAILURE).isNotNull()).alias("failed")), "rows")
        total = seen.get["failed"]
        if total:
            doc = F.col(f"`{rows.columns[0]}`") if len(docs.columns) > 1 else F.lit(None)
            failed = rows.where(F.col(FAILURE).isNotNull())
            sample = failed.select(doc.alias("doc"), FAILURE).orderBy("doc", f"{FAILURE}.node_id").limit(most).collect()
            found = [(r["doc"], r[FAILURE]) for r in sample]
            raise ExtractionError([_failed(doc, f) for doc, f in found], self.model, total)
        return rows.drop(FAILURE)

    def extract(self, source: Any, text_col: str = "text", encoding: str = "utf-8") -> Any:
        """Rows of a DataFrame as a DataFrame; of a text as a list of models in document order. encoding: of texts that are bytes.

        strict: a text with failed rows raises ExtractionError with all of them; a DataFrame's job fails at the first (verified()
        looks at all of them before).
        """
        if isinstance(source, DataFrame):
            return self._finished(self.rows(source, text_col, encoding=encoding))
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        text = source.decode(encoding) if isinstance(source, bytes) else source
        rows = self.rows(spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
        failed = [r for r in rows if r[FAILURE] is not None]
        if failed and self.strict:
            raise ExtractionError([_failed(0, r[FAILURE]) for r in failed], self.model)
        return [self.model.of_row(r) for r in sorted(rows, key=lambda r: r["node_id"]) if r[FAILURE] is None]


def _failed(doc: Any, f: Any) -> MatchFailure:
    return MatchFailure(doc, f["pattern"], f["anchor"], f["line"], f["column"], f["start_byte"], f["end_byte"], tuple(f["errors"]))


def shared_wanted(extractors: list[Extractor]) -> Wanted:
    """What several models need together, so that one parse serves them all."""
    out = Wanted(frozenset(), frozenset())
    for e in extractors:
        w = e.wanted()
        out = replace(
            out, kinds=out.kinds | w.kinds, text=out.text | w.text, wrappers={**out.wrappers, **w.wrappers}, pair_kinds=out.pair_kinds | w.pair_kinds,
            key_leaves={**out.key_leaves, **w.key_leaves}, deep=out.deep or w.deep, children=True,
        )
    return out
