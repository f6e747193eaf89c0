"""Facts about drivers' objects (schemas, checks, builders, builds), each beside the SQL of what it must say. They read no table, so they are
cases for tests and no registered queries."""

from __future__ import annotations

import json
import operator
import tempfile
import types
from collections.abc import Callable
from pathlib import Path
from typing import Annotated, Any, Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syntaxframe.errors import BundleError, SyntaxFrameError
from syntaxframe.functions import coerce
from syntaxframe.grammar import accessors, library, rules
from syntaxframe.grammar.build import build, build_community_bundle, build_from_source_dir, build_loop, cache_key, debug_states, derive_schema_for_dir, grammar_hash, main
from syntaxframe.grammar.conflicts import GrammarConflictError, parse_conflict_json
from syntaxframe.grammar.dsl import B, Grammar, Ladder, alias, as_expr, choice, field, is_blank_pattern, matching_alternative, opt, pattern, prec, ref, repeat, repeat1, seq, token
from syntaxframe.grammar.expressions import expression, semantic_smoke
from syntaxframe.grammar.ir import Expr, GrammarModel
from syntaxframe.grammar.lint import run_checks
from syntaxframe.language import Language, language_for
from syntaxframe.model import M, Matches, NodeKind, OutputModel, RawQuery, Unescaped, capture, capture_kind, derived
from syntaxframe.operators import corpus, render
from syntaxframe.registry import SHAPES, KeyK, broken_grammar
from syntaxframe.registry_more import Entry, HTTPValue, ListRule, NamePath, Number, _class_grammar, _model
from syntaxframe.schema import NodeSchema
from syntaxframe.sources.bundles import load_bundle
from syntaxframe.valuemap import ValueMap, looks_like_json, propose_value_map


CASES, SQL = {}, {}


def query(sql):
    def keep(f):
        CASES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_WAYS = ("list", "object", "text", "file", "bundle", "folder", "command line", "copied")
_BIND = (
    ("unknown kind", "SchemaCheckError"), ("impossible child", "SchemaCheckError"), ("impossible descendant", "SchemaCheckError"), ("missing field", "SchemaCheckError"),
    ("field missing on one anchor", "SchemaCheckError"), ("impossible child kind", "SchemaCheckError"), ("kind does not hold the type", "SchemaCheckError"), ("escapes without a string", "SchemaCheckError"),
    ("raw query, unknown kind", "SchemaCheckError"), ("raw query, unknown capture", "SchemaCheckError"), ("raw query, malformed", "QueryBuildError"), ("record without pairs", "ShapeError"),
    ("wrong pair kind", "ShapeError"), ("no value shape", "ShapeError"), ("both declarations", "ShapeError"), ("nested in field mode", "ShapeError"), ("unresolved annotation", "ShapeError"),
    ("no declaration", "ShapeError"), ("no schema, default pairs", "none"), ("fits", "none"),
)
_DSL = ("alias of a sequence", "sequence operator", "choice operator", "star and plus", "optional", "capture", "site of an expression", "replaced rule", "ladder order", "double level", "empty ordering", "blank patterns", "alternative of a production", "read-only views", "emitted grammar")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SHAPES) + ") x(text, shape)")
def expr_shapes(spark, sf_dir):
    docs = spark.createDataFrame([(t,) for t, _ in SHAPES], "text string")
    got = render.rendered(docs.select(F.lit(1).alias("one"), "text"), language_for("expr"), style="compact", selector="expression_statement")
    return got.select("text", F.regexp_extract("rendered", r"(?s)^\(expression_statement (.*) ;\)$", 1).alias("shape"))


@query("SELECT * FROM (VALUES ('pair', 'key', 'string', TRUE, FALSE), ('pair', 'key', 'number', TRUE, FALSE)) x(kind, field, child, required, multiple)")
def schema_catalog(spark, sf_dir):
    frame = language_for("json").schema.frame(spark)
    return frame.where("kind = 'pair' and field = 'key'").select("kind", "field", "child", "required", "multiple")


@query("SELECT * FROM (VALUES ('document', 'string_content', TRUE), ('pair', 'object', TRUE), ('string', 'object', FALSE), ('number', 'pair', FALSE)) x(ancestor, kind, possible)")
def schema_descend(spark, sf_dir):
    schema = language_for("json").schema
    asked = [("document", "string_content"), ("pair", "object"), ("string", "object"), ("number", "pair")]
    return spark.createDataFrame([(a, k, schema.is_possible_descendant(a, k)) for a, k in asked], "ancestor string, kind string, possible boolean")


@query("SELECT * FROM (VALUES ('undefined', 'source_file', FALSE), ('unused', 'unused', FALSE), ('unused', 'flagged', FALSE), ('unused', 'named', FALSE), ('repeat', 'source_file', FALSE), ('token', 'unused', FALSE), ('flags', 'flagged', FALSE), ('nullable', 'empty', TRUE)) x(check_name, rule, warning)")
def lint_issues(spark, sf_dir):
    rows = [(i.check, i.rule, i.warning) for i in run_checks(broken_grammar())]
    return spark.createDataFrame(rows, "check_name string, rule string, warning boolean")


@query("SELECT CAST(0 AS BIGINT) AS failures")
def corpus_run(spark, sf_dir):
    cases = corpus.Corpus([(t, s, t) for t, s in SHAPES], style="compact").frame(spark)
    cases = cases.withColumn("expected", F.concat(F.lit("(expression_statement "), "expected", F.lit(" ;)")))
    return corpus.failing(cases, language_for("expr"), style="compact", selector="expression_statement").agg(F.count("*").alias("failures"))


def _values(columns: str, *rows: tuple) -> str:
    def shown(v: Any) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") x({columns})"


def _facts(spark, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _raised(act: Callable[[], Any]) -> str:
    """The name of the error that something ends with."""
    try:
        act()
    except (SyntaxFrameError, TypeError, RuntimeError) as error:
        return type(error).__name__
    return "none"


@query(_values("given, says", ("format 1", "conf"), ("no format", "conf"), ("format 99", "BundleError"), ("format '2'", "BundleError"), ("no name", "BundleError"), ("no artifact", "BundleError"), ("wasm", "WasmRuntimeUnavailableError"), ("no schema", "conf"), ("map of the bundle", "int"), ("map of the caller", "str")))
def bundle_rules(spark, sf_dir):
    folder = Path(tempfile.mkdtemp(prefix="bundle-"))
    build(library.BUILDERS["conf"]()).package(folder, value_map=ValueMap({"integer": "int"}))
    said = json.loads((folder / "metadata.json").read_text())

    def with_(**changes: Any) -> str:
        (folder / "metadata.json").write_text(json.dumps({k: v for k, v in {**said, **changes}.items() if v is not None}))
        try:
            return load_bundle(folder).name
        except BundleError as error:
            return type(error).__name__

    rows = [("format 1", with_(bundle_format=1)), ("no format", with_(bundle_format=None)), ("format 99", with_(bundle_format=99)), ("format '2'", with_(bundle_format="2"))]
    rows += [("no name", with_(name=None)), ("no artifact", with_(artifact="gone.json")), ("wasm", with_(artifact="x.wasm")), ("no schema", with_(schema="gone.json"))]
    with_()
    rows.append(("map of the bundle", Language.load_bundle(folder).value_map.scalars["integer"]))
    rows.append(("map of the caller", Language.load_bundle(folder, {"scalars": {"integer": "str"}}).value_map.scalars["integer"]))
    return _facts(spark, "given string, says string", rows)


@query(_values("way, same", *((w, True) for w in _WAYS)))
def schema_sources(spark, sf_dir):
    """The JSON grammar's schema by way of lists, texts, files, bundles, grammar folders and the command line."""
    own, work = language_for("json").schema, Path(tempfile.mkdtemp(prefix="schemas-"))
    (work / "src").mkdir()
    library.BUILDERS["json"]().emit_json(work / "src/grammar.json")
    main([str(work), "-o", str(work / "line.json"), "-n", "json"])
    found = {
        "list": NodeSchema.from_list(own.to_list()), "object": NodeSchema.from_list({"node_types": own.to_list()}), "text": NodeSchema.from_node_types_json(own.to_json()),
        "file": NodeSchema.from_node_types_json(own.write(work / "own.json")), "bundle": load_bundle(build_community_bundle(work, work / "bundle", name="json")).schema,
        "folder": derive_schema_for_dir(work, out=work / "dir.json"), "command line": NodeSchema.from_node_types_json(work / "line.json"), "copied": NodeSchema(list(own)),
    }
    return _facts(spark, "way string, same boolean", [(w, s.to_json() == own.to_json()) for w, s in found.items()])


@query(_values(
    "question, answer",
    ("kind of pair", "pair"), ("kind of nope", None), ("named kinds within kinds", "true"), ("named '{'", "false"), ("children of array", "_value"), ("children of number", ""),
    ("pair has key", "true"), ("pair has nope", "false"), ("subtypes of _value", "array false null number object string true"), ("_value is a supertype", "true"), ("pair is a supertype", "false"),
    ("array to number", "true"), ("number to array", "false"), ("pair can occur", "true"), ("'{' can occur", "false"), ("fields of pair.value", "_value"),
))
def schema_queries(spark, sf_dir):
    s = language_for("json").schema
    said = lambda b: str(bool(b)).lower()
    names = lambda refs: " ".join(sorted(r.type for r in refs))
    rows = [
        ("kind of pair", s.by_type("pair").type), ("kind of nope", getattr(s.get("nope"), "type", None)), ("named kinds within kinds", said(s.named_kinds < s.kinds)), ("named '{'", said("{" in s.named_kinds)),
        ("children of array", names(s.children_types("array"))), ("children of number", names(s.children_types("number"))), ("pair has key", said(s.has_field("pair", "key"))),
        ("pair has nope", said(s.has_field("pair", "nope"))), ("subtypes of _value", names(s.supertype_subtypes("_value"))), ("_value is a supertype", said(s.is_supertype("_value"))),
        ("pair is a supertype", said(s.is_supertype("pair"))), ("array to number", said(s.is_possible_descent("array", "number"))), ("number to array", said(s.is_possible_descent("number", "array"))),
        ("pair can occur", said(s.can_occur("pair"))), ("'{' can occur", said(s.can_occur("{"))), ("fields of pair.value", names(s.field_types("pair", "value"))),
    ]
    return _facts(spark, "question string, answer string", rows)


@query(_values("grammar, kind, role, label", ("conf", "boolean", "scalar", "bool"), ("conf", "integer", "scalar", "int"), ("conf", "list", "array", "boolean integer list string"), ("conf", "string", "wrapper", "string_content"), ("conf", "looks like JSON", "schema", "false"), ("json", "looks like JSON", "schema", "true"), ("json", "number", "scalar", "int"), ("json", "null", "scalar", "null"), ("json", "string", "wrapper", "string_content")))
def value_map_draft(spark, sf_dir):
    rows = []
    for name, kinds in (("conf", ("boolean", "integer", "list", "string")), ("json", ("number", "null", "string"))):
        schema = language_for(name).schema
        draft = propose_value_map(schema)
        for kind in kinds:
            if kind in draft.scalars:
                rows.append((name, kind, "scalar", draft.scalars[kind]))
            elif kind in draft.wrappers:
                rows.append((name, kind, "wrapper", draft.wrappers[kind]))
            elif kind in draft.arrays:
                rows.append((name, kind, "array", " ".join(k for k in sorted(draft.arrays[kind]) if k != "block")))
        rows.append((name, "looks like JSON", "schema", str(looks_like_json(schema)).lower()))
    return _facts(spark, "grammar string, kind string, role string, label string", rows)


@query(_values("given, error", *_BIND))
def bind_errors(spark, sf_dir):
    """What each check of a model against a grammar ends with, before any job runs."""
    json_, expr, ini = language_for("json"), language_for("expr"), language_for("ini")
    no_null = ini.with_schema(ini.schema, ValueMap({"integer": "int"}))
    loose = Language.load("json", schema=False)
    on = lambda language, *a, **k: (lambda: language.extractor(_model(*a, **k)))
    tries = {
        "unknown kind": on(json_, M("nope"), a=str), "impossible child": on(json_, M("pair", "document"), key=str), "impossible descendant": on(json_, M("string", ..., "object"), a=str),
        "missing field": on(expr, M("assignment"), middle=str), "field missing on one anchor": on(expr, M(("assignment", "call")), left=str),
        "impossible child kind": on(expr, M("assignment"), x=(str, capture_kind("document"))), "kind does not hold the type": on(json_, M("document", "object", "pair"), value=Annotated[int, NodeKind("string")]),
        "escapes without a string": on(expr, M("assignment"), left=Annotated[str, Unescaped()]), "raw query, unknown kind": on(json_, raw="(nope) @a", a=str),
        "raw query, unknown capture": on(json_, raw="(number) @b", a=str), "raw query, malformed": on(json_, raw="(number", a=str), "record without pairs": on(json_, M("document", "array", record=True), a=str),
        "wrong pair kind": on(json_, M("object", record=True, record_pair="array"), a=str), "no value shape": on(no_null, M("source_file", "section", record=True), a=int),
        "both declarations": lambda: type("Y", (OutputModel,), {"__match__": M("a"), "__raw_query__": RawQuery("(a)"), "__annotations__": {}}),
        "nested in field mode": lambda: type("Y", (OutputModel,), {"__match__": M("a"), "__annotations__": {"p": KeyK}}),
        "unresolved annotation": lambda: type("Y", (OutputModel,), {"__match__": M("a"), "__annotations__": {"p": "Nowhere"}}), "no declaration": OutputModel.spec,
        "no schema, default pairs": on(loose, M("document", "object", record=True), a=str), "fits": on(json_, M("document", "object", record=True), a=str),
    }
    return _facts(spark, "given string, error string", [(name, _raised(act)) for name, act in tries.items()])


@query(_values("asked, found", ("site of the model", True), ("entry of the schema", True), ("one extractor a model", True), ("another if lenient", True), ("warnings are data", True), ("no checks without a language", True)))
def bind_details(spark, sf_dir):
    """Errors name the model's line and the schema's entry; extractors are kept; unbound fields warn."""
    expr = language_for("expr")

    class Sited(OutputModel):
        __match__ = M("assignment")
        middle: str

    try:
        expr.extractor(Sited)
        said, entry = "", None
    except SyntaxFrameError as error:
        said, entry = str(error), getattr(error, "schema_entry", None)
    loose = type("D", (OutputModel,), {"__match__": M("document"), "__annotations__": {"d": str}, "d": derived()})
    rows = [
        ("site of the model", "authoring_cases.py" in said), ("entry of the schema", getattr(entry, "type", None) == "assignment"), ("one extractor a model", language_for("json").extractor(KeyK) is language_for("json").extractor(KeyK)),
        ("another if lenient", language_for("json").extractor(KeyK) is not language_for("json").extractor(KeyK, strict=False)), ("warnings are data", len(loose.validate_with("json")) == 1),
        ("no checks without a language", "middle" in Sited.compiled_source()),
    ]
    return _facts(spark, "asked string, found boolean", rows)


@query(_values("form, text", ("field", "(source_file (assignment left: (identifier) @name (#match? @name \"^A\") right: (_)? @right @_anchor))"), ("record", "; record\n(document (object \"k\": [(number) (string)] @k @_anchor))"), ("raw", "(call) @c")))
def explained_models(spark, sf_dir):
    field_model = _model(M("source_file", "assignment"), name=(Annotated[str, Matches("^A"), NodeKind("identifier")], capture("left")), right=(str | None, None))
    record_model = _model(M("document", "object", record=True), k=Annotated[int | str, NodeKind("number", "string")])
    rows = [("field", field_model.compiled_source()), ("record", record_model.compiled_source()), ("raw", _model(raw="(call) @c", c=str).compiled_source())]
    return _facts(spark, "form string, text string", rows)


@query(_values("name, shown", ("string_content", "StringContent"), ("_value", "Value"), ("1st", "Kind1st"), ("node", "field_node"), ("class", "field_class"), ("left", "left")))
def accessor_names(spark, sf_dir):
    rows = [(n, accessors.class_name(n)) for n in ("string_content", "_value", "1st")] + [(n, accessors.attribute_name(n)) for n in ("node", "class", "left")]
    return _facts(spark, "name string, shown string", rows)


@query(_values("grammar, same, hash_stays, sites_ignored, first_rule_starts", *((n, True, True, True, True) for n in sorted(library.BUILDERS))))
def ir_round_trips(spark, sf_dir):
    """Grammars through JSON: equal, with the same hash, without their sites; unknown keys are refused."""
    rows = []
    for name in sorted(library.BUILDERS):
        model = library.grammar(name)
        data = json.loads(json.dumps({"$schema": "x", **model.to_json()}))
        again = GrammarModel.from_json(data)
        refused = _raised(lambda: GrammarModel.from_json({**data, "odd": 1})) == "GrammarError"
        rows.append((name, again == model and refused, grammar_hash(again) == grammar_hash(model), not again.sites and bool(model.sites), again.start == next(iter(again.rules))))
    return _facts(spark, "grammar string, same boolean, hash_stays boolean, sites_ignored boolean, first_rule_starts boolean", rows)


@query(_values("given, holds", *((n, True) for n in _DSL)))
def builder_rules(spark, sf_dir):
    g = Grammar("g", start="a")
    g.rule("a", choice(seq(ref("b"), "x"), "y"), ambiguous=True, supertype=True)
    first = g.build()
    g.replace_rule("a", seq("z", opt(ref("b"))))
    g.rule("b", pattern("[a-z]"), word=True)
    g.precedence("loose", "tight")
    views = [g.start_rule == "a", g.word_view == "b", g.extras_view == (), g.externals_view == (), dict(g.reserved_view) == {}]
    work = Path(tempfile.mkdtemp(prefix="grammar-")) / "grammar.json"
    facts = {
        "alias of a sequence": _raised(lambda: alias(seq("a", "b"), "c")) == "GrammarError", "sequence operator": (B("a") + "b").expr == seq("a", "b"), "choice operator": ("a" | B("b")).expr == choice("a", "b"),
        "star and plus": (B("a").star.expr, B("a").plus.expr) == (repeat("a"), repeat1("a")), "optional": B("a").opt.expr == opt("a"), "capture": B("a").capture("f").expr == field("f", "a"),
        "site of an expression": "authoring_cases.py" in str(seq("a", "b").site) and seq("a", "b") == Expr("SEQ", members=(as_expr("a"), as_expr("b"))), "replaced rule": first.conflicts == [["a"]] and g.build().conflicts == [] and g.build().supertypes == [],
        "ladder order": Ladder("or", "and").n("and") > Ladder("or", "and").n("or"), "double level": _raised(lambda: Ladder("a", "a")) == "GrammarError", "empty ordering": _raised(g.precedence_ordering) == "GrammarError",
        "blank patterns": [is_blank_pattern(pattern(p)) for p in (r"\s", " ", r"[ \t]", "a")] == [True, True, True, False], "alternative of a production": matching_alternative(first.rules["a"], ["b", "'x'"]) == seq(ref("b"), "x") and matching_alternative(first.rules["a"], ["x"]) is None,
        "read-only views": all(views) and _raised(lambda: operator.setitem(g.rules_view, "a", 1)) == "TypeError",
        "emitted grammar": GrammarModel.load(g.emit_json(work)) == g.build(),
    }
    return _facts(spark, "given string, holds boolean", list(facts.items()))


@query(_values("given, says", ("HTTPValue", "http_value"), ("ListRule", "list"), ("NamePath", "name_path"), ("wrong default", "GrammarError"), ("imported classes", "0"), ("order of rules", "note number name_path"), ("attribute line", "key: NamePath")))
def rule_class_names(spark, sf_dir):
    def wrong():
        class Bad(rules.Rule):
            eq: Literal["="] = ":"

        rules.body_of(Bad)

    bare = types.ModuleType("bare")
    bare.Number = Number
    order = [n for n in _class_grammar().rules][:3]
    rows = [(c.__name__, c.rule_name()) for c in (HTTPValue, ListRule, NamePath)] + [("wrong default", _raised(wrong)), ("imported classes", str(len(rules.module_rules(bare)))), ("order of rules", " ".join(order))]
    return _facts(spark, "given string, says string", [*rows, ("attribute line", rules.attribute_sites(Entry)["key"].text)])


@query(_values("operators, differences", ("as meant", 0), ("sum tighter than product", 3)))
def semantic_smoke_cases(spark, sf_dir):
    swapped = Grammar("swapped", start="source_file")
    swapped.rule("source_file", repeat(seq(ref("e"), ";")))
    swapped.rule("identifier", pattern("[a-z]+"), word=True)
    swapped.rule("number", pattern("[0-9]+"))
    ladder = Ladder("or", "product", "sum", "unary", "power", "call")
    expression(swapped, "e", primary=("identifier", "number"), ladder=ladder, infix={"or": ("or",), "sum": ("+", "-"), "product": ("*",)}, right={"power": ("^",)}, prefix={"unary": ("-",)}, postfix={"call": ("call", lambda e: seq(field("function", e), "(", field("argument", e), ")"))})
    rows = [("as meant", len(semantic_smoke(language_for("expr").parse))), ("sum tighter than product", len(semantic_smoke(Language.load(swapped).parse)))]
    return _facts(spark, "operators string, differences long", rows)


@query(_values("check_name, rule, warning", ("start", "nope", False), ("alias", "source_file", False), ("precedence", "source_file", True), ("extras", "source_file", True)))
def lint_more(spark, sf_dir):
    g = Grammar("g")
    g.rule("source_file", choice(prec(1, "a"), prec("x", "b"), Expr("ALIAS", value="z", named=True, content=prec(1, seq("a", "b")))))
    g.extra(token(seq("a", pattern("[^\n]*"))))
    found = {(i.check, i.rule, i.warning) for i in [*run_checks(g), *run_checks(Grammar("m", start="nope"))] if i.check in ("start", "alias", "precedence", "extras")}
    return _facts(spark, "check_name string, rule string, warning boolean", sorted(found))


def _dangling() -> Grammar:
    g = Grammar("g")
    g.rule("source_file", ref("s"))
    g.rule("s", choice(ref("cond"), "x"))
    g.rule("cond", choice(seq("if", "e", ref("s")), seq("if", "e", ref("s"), "else", ref("s"))))
    return g


@query(_values(
    "asked, says",
    ("shape", "'if' 'e' s • 'else'"), ("rules", "cond"), ("fixes", "AddConflict Associativity Precedence"), ("sites", "true"), ("from a report", "a { • '}'"), ("another report", "none"),
    ("after a fix", "tables"), ("without a fix", "RuntimeError"), ("states", "true"),
))
def conflict_reports(spark, sf_dir):
    try:
        build(_dangling(), analyse=False)
        raise AssertionError("a conflict was expected")
    except GrammarConflictError as error:
        found = error
    report = {"symbol_sequence": ["a", "{"], "conflicting_lookahead": "'}'", "possible_interpretations": [], "possible_resolutions": []}
    parsed = parse_conflict_json("noise { \n" + json.dumps({"BuildTables": {"Conflict": report}}))

    def fix(error, grammar):
        grammar.replace_rule("cond", choice(seq("if", "e", ref("s")), prec(1, seq("if", "e", ref("s"), "else", ref("s")))))

    steps = list(build_loop(_dangling(), fix=fix, analyse=False))
    kinds = sorted({str(r["type"]) for r in found.conflict.possible_resolutions})
    rows = [
        ("shape", found.conflict.ambiguous_shape), ("rules", " ".join(found.conflict.involved_rules)), ("fixes", " ".join(kinds)),
        ("sites", str(any("authoring_cases.py" in str(s) for s in found.sites.values())).lower()), ("from a report", parsed.ambiguous_shape),
        ("another report", "none" if parse_conflict_json(json.dumps({"BuildTables": {"Other": 1}})) is None else "some"), ("after a fix", "tables" if steps[-1].tables else ""),
        ("without a fix", _raised(lambda: list(build_loop(_dangling(), fix=lambda e, g: None, max_attempts=2)))), ("states", str("•" in debug_states(_dangling(), "cond")).lower()),
    ]
    return _facts(spark, "asked string, says string", rows)


@query(_values(
    "asked, says",
    ("first build", "made"), ("second build", "cached"), ("key without scanner", "other"), ("key of another grammar", "other"), ("scanner missing", "ExternalScannerRequiredError"), ("scanner unknown", "CompileError"),
    ("errors of checks", "GrammarCheckError"), ("a folder without grammar", "PipelineError"), ("scanner beside", "bash_heredoc"), ("package", "grammar.json metadata.json node-schema.json typed_api.py"), ("no arguments", "2"),
    ("dangling option", "2"), ("corpus snapshots", "grammar.json node-schema.json"), ("process result", "GenerateError"),
))
def grammar_builds(spark, sf_dir):
    """Building: cache by content, what is refused, bundles, the command line, snapshots beside corpora."""
    import contextlib
    import io

    work = Path(tempfile.mkdtemp(prefix="builds-"))
    first, second = (build(library.BUILDERS["conf"](), cache_dir=work / "cache") for _ in range(2))
    model = library.grammar("shell")
    (work / "shell").mkdir()
    model.emit_json(work / "shell/grammar.json")
    bad = Grammar("bad")
    bad.rule("source_file", ref("nowhere"))
    with contextlib.redirect_stderr(io.StringIO()):
        none, dangling = main([]), main([str(work), "-o"])
    corpus.Corpus([corpus.corpus_case("a = 1;", "x")]).run(grammar=library.BUILDERS["conf"](), snapshots_dir=work / "snaps")
    undefined = Grammar("undefined")
    undefined.rule("source_file", seq(ref("nowhere"), "x"))
    names = lambda p: " ".join(sorted(x.name for x in p.iterdir()))
    rows = [
        ("first build", "cached" if first.cached else "made"), ("second build", "cached" if second.cached else "made"), ("key without scanner", "same" if cache_key(model, None) == cache_key(model, "bash_heredoc") else "other"),
        ("key of another grammar", "same" if first.key == build(library.BUILDERS["json"]()).key else "other"), ("scanner missing", _raised(lambda: build(model))), ("scanner unknown", _raised(lambda: build(model, scanner="nope"))),
        ("errors of checks", _raised(lambda: build(bad))), ("a folder without grammar", _raised(lambda: build_from_source_dir(work / "cache"))), ("scanner beside", build_from_source_dir(work / "shell").scanner),
        ("package", names(first.package(work / "bundle", typed_api=True))), ("no arguments", str(none)), ("dangling option", str(dangling)), ("corpus snapshots", names(work / "snaps")),
        ("process result", _raised(lambda: build(undefined, analyse=False))),
    ]
    return _facts(spark, "asked string, says string", rows)


@query(_values("nth, line", (1, "1 of 2 cases passed"), (2, "bad"), (3, "--- expected"), (4, "+++ got"), (5, "@@ -1 +1 @@"), (6, "-(identifier)"), (7, "+(number)")))
def corpus_reports(spark, sf_dir):
    cases = [corpus.Case("1;", "(expression_statement (number) ;)", "good", "expression_statement"), corpus.Case("2;", "(identifier)", "bad", "number")]
    run = corpus.Corpus(cases, style="compact").run(language=language_for("expr"))
    return _facts(spark, "nth long, line string", [(i + 1, x) for i, x in enumerate(run.report().split("\n"))])


INTS = (("3", 3), ("+5", 5), (" 7 ", 7), ("-0", 0), ("3.0", 3), ("1_000", 1000), ("3.14", None), ("0x1f", None), ("", None), ("1e3", None), ("9" * 25, None))
FLOATS = (("1e3", 1000.0), (" 2.5 ", 2.5), ("1_0.5", 10.5), (".5", 0.5), ("5.", 5.0), ("x", None), ("", None))
BOOLS = (("true", True), ("Yes", True), ("on", True), ("1", True), ("t", True), ("off", False), ("0", False), ("N", False), ("maybe", None), ("", None))


def _coerced(rows, kind: str) -> str:
    def shown(v) -> str:
        return "NULL" if v is None else str(v)

    return "SELECT text, CAST(v AS " + kind + ") AS v FROM (VALUES " + ", ".join(f"('{t}', {shown(v)})" for t, v in rows) + ") x(text, v)"


def _converted(spark, rows, f):
    return spark.createDataFrame([(t,) for t, _ in rows], "text string").select("text", f(F.col("text")).alias("v"))


@query(_coerced(INTS, "BIGINT"))
def coerce_int(spark, sf_dir):
    return _converted(spark, INTS, coerce.to_int)


@query(_coerced(FLOATS, "DOUBLE"))
def coerce_float(spark, sf_dir):
    return _converted(spark, FLOATS, coerce.to_float)


@query(_coerced(BOOLS, "BOOLEAN"))
def coerce_bool(spark, sf_dir):
    return _converted(spark, BOOLS, coerce.to_bool)
