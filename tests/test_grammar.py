"""Grammars: expressions, builder, classes, checks, tables, conflicts, schemas, scanners, bundles."""

import json
import sys
from typing import Literal

import pytest

from syntaxframe.errors import BundleError, GrammarCheckError, GrammarError, WasmRuntimeUnavailableError
from syntaxframe.grammar import library, patterns, rules
from syntaxframe.grammar.accessors import attribute_name, class_name, generate_typed_api
from syntaxframe.grammar.build import ExternalScannerRequiredError, build, build_from_source_dir, build_loop, debug_states, main
from syntaxframe.grammar.conflicts import GrammarConflictError, parse_conflict_json
from syntaxframe.grammar.derive import derive_schema
from syntaxframe.grammar.dsl import B, Grammar, Ladder, alias, choice, field, is_blank_pattern, opt, pattern, prec, prec_left, ref, repeat, repeat1, seq, token
from syntaxframe.grammar.ir import KINDS, Expr, GrammarModel
from syntaxframe.grammar.lint import errors, nullable_rules, run_checks, warnings
from syntaxframe.grammar.tables import build_tables
from syntaxframe.language import Language, language_for
from syntaxframe.operators.corpus import Corpus, corpus_case
from syntaxframe.operators.render import render, render_compact
from syntaxframe.parse.runtime import Parser
from syntaxframe.registry import SHAPES, broken_grammar
from syntaxframe.schema import NodeSchema
from syntaxframe.sources.bundles import load_bundle
from syntaxframe.valuemap import ValueMap, propose_value_map


def tree(grammar, text, **options):
    return render(Language.load(grammar, **options).parse(text), anonymous="drop")


# Expressions and the builder.


def test_every_kind_survives_json():
    leaf = Expr("BLANK")
    made = [Expr(k, **{p: {"members": (leaf,), "content": leaf, "name": "n", "value": 1, "named": True, "flags": "i", "context_name": "c"}[p] for p in parts}) for k, parts in KINDS.items()]
    assert [Expr.from_json(e.to_json()) for e in made] == made
    with pytest.raises(GrammarError):
        Expr.from_json({"type": "BLANK", "odd": 1})
    with pytest.raises(GrammarError):
        Expr("PREC_DYNAMIC", value="x", content=leaf)


@pytest.mark.parametrize("name", sorted(library.BUILDERS))
def test_library_grammars_round_trip_and_have_schemas(name):
    model = library.grammar(name)
    assert GrammarModel.from_json(json.loads(json.dumps(model.to_json()))) == model
    schema = derive_schema(model)
    assert NodeSchema.from_list(schema.to_list()) == schema and schema.get(model.start, True).root
    assert not errors(model)


def test_combinators():
    assert seq("a", seq("b", "c")) == seq("a", "b", "c") and choice("a", choice("b")) == choice("a", "b")
    assert opt("a") == choice("a", Expr("BLANK")) and (B("a") + "b").expr == seq("a", "b") and ("a" | B("b")).expr == choice("a", "b")
    assert B("a").star.expr == repeat("a") and B("a").plus.expr == repeat1("a") and B("a").capture("f").expr == field("f", "a")
    with pytest.raises(GrammarError):
        alias(seq("a", "b"), "c")
    assert seq("a").site.file == __file__ and seq("a") == seq("a")


def test_ladder_and_grammar_options():
    ladder = Ladder("or", "and")
    ladder.insert("not", after="and").insert("xor", before="and")
    assert ladder.levels == ["or", "xor", "and", "not"] and ladder["not"] == ladder.n("not") == 4 and ladder.ordering()[0] == "not"
    with pytest.raises(GrammarError):
        ladder.n("nope")
    with pytest.raises(GrammarError):
        Ladder("a", "a")
    g = Grammar("g")
    g.rule("source_file", "a", ambiguous=True)
    with pytest.raises(GrammarError):
        g.rule("source_file", "b")
    assert g.rule("x", "b", hidden=True).name == "_x" and g.build().conflicts == [["source_file"]]
    g.replace_rule("source_file", "c")
    assert g.build().conflicts == [] and g.build().extras == [pattern(r"\s")]
    assert [is_blank_pattern(pattern(p)) for p in (r"\s", " ", r"[ \t\r\n]+", r"\s+", "a", r"[ a]")] == [True, True, True, True, False, False]


def test_rule_classes_equal_the_builder():
    class Comment(rules.Extra, rules.Token):
        __body__ = seq("#", pattern(patterns.rest_of_line()))

    class Number(rules.Pattern):
        __pattern__ = patterns.integer()

    class NamePath(rules.Token):
        __pattern__ = patterns.dotted_path()

    class Value(rules.Supertype):
        __body__ = choice(rules.R(Number), ref("list"))

    class ListRule(rules.Rule):
        __rule_name__ = "list"
        opening: Literal["["] = "["
        element: list[Value]
        closing: Literal["]"] = "]"

    class HTTPPair(rules.Rule):
        key: NamePath
        eq: Literal["="] = "="
        value: Value | None

    class SourceFile(rules.Rule):
        content: list[HTTPPair]

    made = rules.assemble("g", start=SourceFile, rules=[Comment, Number, NamePath, Value, ListRule, HTTPPair, SourceFile]).build()
    g = Grammar("g")
    g.rule("comment", token(seq("#", pattern(r"[^\n]*"))))
    g.extra(ref("comment"))
    g.rule("number", pattern("[0-9]+"))
    g.rule("name_path", token(pattern(patterns.dotted_path())))
    g.rule("value", choice(ref("number"), ref("list")), supertype=True)
    g.rule("list", seq("[", repeat(field("element", ref("value"))), "]"))
    g.rule("http_pair", seq(field("key", ref("name_path")), "=", field("value", opt(ref("value")))))
    g.rule("source_file", repeat(ref("http_pair")))
    assert made == g.build()
    with pytest.raises(GrammarError):

        class Bad(rules.Rule):
            eq: Literal["="] = ":"

        rules.body_of(Bad)
    assert rules.module_rules(sys.modules[__name__]) == []


# Checks.


def test_checks_find_what_is_planted():
    found = {(i.check, i.rule) for i in run_checks(broken_grammar())}
    assert {("undefined", "source_file"), ("repeat", "source_file"), ("token", "unused"), ("flags", "flagged"), ("nullable", "empty")} <= found
    g = Grammar("g")
    g.rule("source_file", choice(prec(1, "a"), prec("x", "b"), Expr("ALIAS", value="z", named=True, content=prec(1, seq("a", "b")))))
    g.extra(token(seq("a", pattern("[^\n]*"))))
    kinds = {i.check: i.warning for i in run_checks(g)}
    assert kinds["precedence"] and kinds["extras"] and not kinds["alias"]
    with pytest.raises(GrammarCheckError):
        build(g)
    assert [i.check for i in run_checks(Grammar("e"))] == ["start"] and warnings(library.grammar("json")) == []


def test_nullability():
    g = GrammarModel("g", {"a": seq(ref("b"), repeat("x")), "b": opt("y"), "c": repeat1("z"), "d": pattern("q*"), "e": choice("x", ref("a"))})
    assert nullable_rules(g) == {"a", "b", "d", "e"}


# Trees.


@pytest.mark.parametrize(("source", "shape"), SHAPES)
def test_expression_shapes(source, shape):
    node = language_for("expr").parse(source)
    assert render_compact(node) == f"(source_file (expression_statement {shape} ;))"


def test_json_trees_and_errors():
    assert tree("json", '{"a": [1, null]}') == "(document (object (pair (string (string_content)) (array (number) (null)))))"
    assert language_for("json").parse("").kind == "document"
    for bad in ('{"a": 1', '{"a" 1}', "[1,,2]", "}", '{"a": }', "\x00", '"open'):
        root = language_for("json").parse(bad)
        assert root.first_error() is not None and (root.start, root.end) == (0, len(bad))


def test_hidden_alias_inline_fields():
    g = Grammar("g")
    g.rule("source_file", repeat(choice(ref("_wrap"), ref("call"))))
    g.rule("_wrap", seq("<", field("inside", ref("name")), ">"))
    g.rule("call", seq(field("fn", alias(ref("name"), "callee")), "(", repeat(field("arg", ref("_wrap"))), ")"))
    g.rule("name", pattern("[a-z]+"))
    root = Language.load(g).parse("<x> f(<y> <z>)")
    assert render(root, anonymous="drop", fields=True) == "(source_file inside: (name) (call fn: (callee) inside: (name) inside: (name)))"
    schema = derive_schema(g.build())
    assert schema.get("call").fields["fn"].types[0].type == "callee" and schema.get("call").fields["inside"].multiple
    assert schema.get("source_file").fields["inside"].required is False


def test_keywords_and_reserved_words():
    g = Grammar("g")
    g.rule("source_file", repeat(choice(ref("when"), ref("name"))))
    g.rule("when", seq("if", ref("name")))
    g.rule("name", pattern("[a-z]+"), word=True)
    assert tree(g, "iffy if x") == "(source_file (name) (when (name)))"
    g.reserved_word("default", "if")
    assert Language.load(g).parse("if if").first_error() is not None


def dangling(**flags):
    g = Grammar("g")
    g.rule("source_file", ref("s"))
    g.rule("s", choice(ref("cond"), "x"), **flags)
    g.rule("cond", choice(seq("if", "e", ref("s")), seq("if", "e", ref("s"), "else", ref("s"))))
    return g


def test_conflicts_are_reported_declared_or_fixed():
    with pytest.raises(GrammarConflictError) as caught:
        build_tables(dangling().build())
    assert caught.value.conflict.conflicting_lookahead == "'else'" and "cond" in caught.value.conflict.involved_rules and caught.value.fixes
    g = dangling()
    g.conflict("cond")
    tables = build_tables(g.build())
    assert tables.forking
    root = Parser(tables).parse("if e if e x else x")
    assert root.first_error() is None and root.kind == "source_file"
    g = dangling()

    def fix(error, grammar):
        grammar.replace_rule("cond", choice(seq("if", "e", ref("s")), Expr("PREC", value=1, content=seq("if", "e", ref("s"), "else", ref("s")))))

    steps = list(build_loop(g, fix=fix, analyse=False))
    assert isinstance(steps[0], GrammarConflictError) and steps[-1].tables
    with pytest.raises(RuntimeError):
        list(build_loop(dangling(), fix=lambda e, g: None, max_attempts=2))
    assert "•" in debug_states(g, "cond")


def test_dynamic_precedence_chooses_a_fork():
    g = Grammar("g")
    g.rule("source_file", choice(ref("plain"), ref("strong")))
    g.rule("plain", seq("a", "b"), dynamic=-1)
    g.rule("strong", seq("a", "b"), dynamic=5)
    g.conflict("plain", "strong")
    assert tree(g, "ab") == "(source_file (strong))"


def test_conflict_json_in_noise():
    inner = {"symbol_sequence": ["a", "{"], "conflicting_lookahead": "'}'", "possible_interpretations": [{"variable_name": "x"}, {"variable_name": "x"}], "possible_resolutions": []}
    found = parse_conflict_json("warn { not json\n" + json.dumps({"BuildTables": {"Conflict": inner}}) + " tail }")
    assert found.symbol_sequence == ("a", "{") and found.involved_rules == ["x"] and found.ambiguous_shape == "a { • '}'"
    assert parse_conflict_json(json.dumps({"BuildTables": {"Other": 1}})) is None and parse_conflict_json("{") is None


def test_corpus_reports_differences(tmp_path):
    cases = [corpus_case(s, f"(expression_statement {e} ;)", selector="expression_statement") for s, e in SHAPES]
    assert Corpus(cases, style="compact").run(grammar=library.BUILDERS["expr"](), snapshots_dir=tmp_path).ok()
    assert (tmp_path / "node-schema.json").exists()
    bad = Corpus([corpus_case("1;", "(wrong)", "n")]).run(language=language_for("expr"))
    assert not bad.ok() and "0 of 1" in bad.report() and "+(source_file" in bad.report()


# Scanners.


def indented(scanner):
    g = Grammar("g", default_whitespace=False)
    g.external("NEWLINE", "INDENT", "DEDENT")
    g.extra(pattern(r"[ \t]"))
    if scanner == "py_indent":
        g.extra(pattern(r"#[^\n]*"))
    g.rule("source_file", repeat(ref("statement")))
    g.rule("statement", seq(field("name", ref("word")), choice(ref("NEWLINE"), seq(":", ref("NEWLINE"), ref("INDENT"), repeat1(ref("statement")), ref("DEDENT")))))
    g.rule("word", pattern("[a-z]+"))
    return g


@pytest.mark.parametrize("scanner", ["indent", "py_indent"])
def test_indentation(scanner):
    language = build(indented(scanner), scanner=scanner, analyse=False).language()
    root = language.parse("a:\n  b\n  c:\n    d\n\ne\n")
    assert root.first_error() is None
    names = [(n.text("a:\n  b\n  c:\n    d\n\ne\n"), sum(1 for _ in n.walk())) for _, n in root.children]
    assert len(names) == 2
    assert language.parse("a:\nb\n").first_error() is not None


def test_python_lines_skip_comments_and_joins():
    root = build(indented("py_indent"), scanner="py_indent", analyse=False).language().parse("a:\n  b\n# note\n  c\nd\n")
    assert root.first_error() is None and len(root.children) == 2


def test_heredocs_and_brackets():
    text = "cat <<A <<-'B'\none\nA\n\ttwo\n\tB\nX=1\n"
    root = language_for("shell").parse(text)
    bodies = [n.text(text) for n in root.walk() if n.kind == "heredoc_body"]
    assert bodies[:1] == ["one\nA"]
    g = Grammar("g")
    g.external("MATCHED")
    g.rule("source_file", repeat(choice(ref("MATCHED"), ref("word"))))
    g.rule("word", pattern("[a-z]+"))
    language = build(g, scanner="matched_delimiter", analyse=False).language()
    assert tree(language, "a (b (c) d) e") == "(source_file (word) (MATCHED) (word))"
    assert language.parse("a (b").first_error() is not None
    with pytest.raises(ExternalScannerRequiredError):
        build(g, analyse=False)


# Bundles, cache, accessors.


def test_bundles_round_trip_and_refuse(tmp_path):
    values = ValueMap({"integer": "int"}, {"string": "string_content"})
    first = build(library.BUILDERS["conf"](), cache_dir=tmp_path / "cache")
    again = build(library.BUILDERS["conf"](), cache_dir=tmp_path / "cache")
    assert not first.cached and again.cached and first.key == again.key and first.schema == again.schema
    folder = first.package(tmp_path / "bundle", value_map=values, typed_api=True)
    language = Language.load_bundle(folder)
    assert language.value_map == values and language.schema == first.schema and tree(language, "a = 1;").startswith("(source_file (binding")
    assert Language.load_bundle(folder, {"scalars": {"integer": "str"}}).value_map.scalars == {"integer": "str"}
    said = json.loads((folder / "metadata.json").read_text())

    def broken(**changes):
        (folder / "metadata.json").write_text(json.dumps({k: v for k, v in {**said, **changes}.items() if v is not None}))
        return load_bundle(folder)

    assert broken(bundle_format=None).name == "conf" and broken(bundle_format=1).name == "conf"
    for changes in ({"bundle_format": 99}, {"bundle_format": "2"}, {"name": None}, {"artifact": "gone.json"}):
        with pytest.raises(BundleError):
            broken(**changes)
    with pytest.raises(WasmRuntimeUnavailableError):
        broken(artifact="x.wasm")
    with pytest.raises(BundleError):
        load_bundle(tmp_path)


def test_source_folders_and_command_line(tmp_path, capsys):
    (tmp_path / "src").mkdir()
    library.grammar("json").emit_json(tmp_path / "src/grammar.json")
    assert build_from_source_dir(tmp_path, name="other").model.name == "other"
    assert main([]) == 2 and main([str(tmp_path), "-o", str(tmp_path / "out.json")]) == 0
    assert NodeSchema.from_node_types_json(tmp_path / "out.json") == language_for("json").schema
    assert main([str(tmp_path)]) == 0 and '"pair"' in capsys.readouterr().out


def test_typed_accessors_run():
    scope: dict = {}
    exec(generate_typed_api(language_for("json").schema), scope)
    text = '{"a": [1, 2]}'
    doc = scope["wrap"](language_for("json").parse(text), text)
    pair = doc.children("object")[0].children("pair")[0]
    assert (pair.key.text, [c.text for c in pair.value.children()]) == ('"a"', ["1", "2"]) and "Value" in scope
    assert class_name("string_content") == "StringContent" and attribute_name("node") == "field_node"


def test_proposed_value_map():
    values = propose_value_map(language_for("conf").schema)
    assert values.scalars["integer"] == "int" and values.scalars["boolean"] == "bool" and values.wrappers["string"] == "string_content" and "list" in values.arrays
    assert prec_left(1, "a").value == 1


def test_a_literal_of_several_values_is_a_field():
    class Sign(rules.Rule):
        op: Literal["+", "-"]
        end: Literal[";"] = ";"

    class Signs(rules.Rule):
        ops: list[Literal["+", "-"]]
        last: Literal["<", ">"] | None

    body = rules.body_of(Sign)
    assert [m.kind for m in body.members] == ["FIELD", "STRING"] and body.members[0].name == "op" and body.members[0].content.kind == "CHOICE"
    many, last = rules.body_of(Signs).members
    assert many.content.kind == "FIELD" and many.content.name == "ops" and last.kind == "FIELD" and last.name == "last"


def test_a_grammar_is_like_json_with_all_nine_kinds_only():
    from syntaxframe.language import language_for
    from syntaxframe.schema import NodeSchema
    from syntaxframe.valuemap import JSON_CORE, looks_like_json

    assert len(JSON_CORE) == 9 and looks_like_json(language_for("json").schema)
    for missing in sorted(JSON_CORE):
        less = NodeSchema.from_list([{"type": k, "named": True} for k in sorted(JSON_CORE - {missing})])
        assert not looks_like_json(less)
    assert looks_like_json(NodeSchema.from_list([{"type": k, "named": True} for k in sorted(JSON_CORE | {"escape_sequence"})]))
