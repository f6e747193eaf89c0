"""Registered queries of the authoring side: sources, schemas, checks, grammars, builds, scanners, and plans over them.

Where an operator works on texts, its grammar runs over texts made of table rows, as in registry.py. Checks of models and
grammars run on the driver by nature; their queries give what they found as rows, beside what they should find.
"""

from __future__ import annotations

import tempfile
import types
from collections.abc import Iterator
from pathlib import Path
from typing import Annotated, Any, Literal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grammar import accessors, library, patterns, rules
from .grammar.build import build, build_community_bundle, build_from_source_dir
from .grammar.dsl import Grammar, Ladder, alias, choice, field, immediate_token, opt, pattern, prec, ref, repeat, repeat1, reserved, seq
from .grammar.expressions import expression
from .language import Language, _worker_parser, language_for
from .model import M, NodeKind, OutputModel, RawQuery
from .operators import render
from .parse.runtime import same_trees
from .parse.rows import Wanted
from .registry import KeyK, _assignments, _conf_docs, _events, _table, _text, query
from .sources.docs import spread


def _model(path: M | None = None, raw: str | None = None, **fields: Any) -> type[OutputModel]:
    values = {n: v[1] for n, v in fields.items() if isinstance(v, tuple)}
    hints = {n: v[0] if isinstance(v, tuple) else v for n, v in fields.items()}
    body = {"__annotations__": hints, "__module__": __name__, **values}
    body["__raw_query__" if raw is not None else "__match__"] = RawQuery(raw) if raw is not None else path
    return type("X", (OutputModel,), body)


# Sources of languages.

_KEYS = "SELECT way, (SELECT COUNT(*) FROM events) AS n, (SELECT CAST(SUM(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) FROM events) AS total FROM (VALUES {}) x(way)"


@query(_KEYS.format("('module'), ('function'), ('builder'), ('model'), ('tables'), ('bundle'), ('folder')"))
def language_sources(spark, sf_dir):
    """One extraction with the same grammar from a module, a function, a builder, a model, tables, a bundle and a source folder."""
    work = Path(tempfile.mkdtemp(prefix="languages-"))
    (work / "src").mkdir()
    library.grammar("json").emit_json(work / "src/grammar.json")
    module = types.ModuleType("json_grammar")
    module.language = lambda: library.grammar("json")
    bundle = build_community_bundle(work, work / "bundle")
    ways = {
        "module": Language.from_module(module), "function": Language.load(library.BUILDERS["json"]), "builder": Language.load(library.BUILDERS["json"]()),
        "model": Language.load(library.grammar("json")), "tables": Language.load(language_for("json").tables, language_for("json").schema),
        "bundle": Language.load_bundle(bundle), "folder": build_from_source_dir(work).language(),
    }
    parts = [KeyK.extract(_events(spark, sf_dir), language=l).agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("way", F.lit(w)) for w, l in ways.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("way", "n", "total")


# Checks of models against grammars.


# Captures and raw queries over texts.


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, v AS value FROM nation, (VALUES ('number'), ('string')) x(k), LATERAL (SELECT CASE WHEN k = 'number' THEN CAST(n_nationkey AS VARCHAR) ELSE '\"' || n_name || '\"' END) y(v)")
def wildcard_capture(spark, sf_dir):
    """Any named node as a child of a list; a string kind that is named is captured whole, quotes and all."""
    text = _text("[", F.col("n_nationkey"), ', "', F.col("n_name"), '"]')
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    model = _model(raw="(array (_) @value)", value=str)
    return language_for("json").extractor(model).extract(docs).select("doc_id", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '\"' || n_name || '\"' AS whole FROM nation")
def kind_captured_whole(spark, sf_dir):
    text = _text('{"a": "', F.col("n_name"), '"}')
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    model = _model(M("document", "object", record=True), a=Annotated[str, NodeKind("string")])
    return language_for("json").extractor(model).extract(docs).select("doc_id", F.col("a").alias("whole"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '' AS close FROM nation WHERE n_nationkey % 3 = 0")
def missing_capture(spark, sf_dir):
    """A bracket that recovery puts in is captured as an empty text."""
    end = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(";")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text(F.col("n_name"), " = ", F.col("n_nationkey"), end).alias("text"))
    model = _model(raw='(assignment ";" @close (#eq? @close ""))', close=str)
    return language_for("expr").extractor(model).extract(docs).select("doc_id", "close")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, t AS test FROM nation, (VALUES ('match'), ('eq'), ('any'), ('not eq'), ('not match')) x(t) WHERE CASE t WHEN 'match' THEN n_name LIKE 'A%' WHEN 'eq' THEN n_name = 'NATION_3' OR n_name = 'CHINA' WHEN 'any' THEN n_nationkey IN (1, 2, 30) WHEN 'not eq' THEN n_nationkey <> 7 ELSE n_name NOT LIKE '%A%' END")
def raw_predicates(spark, sf_dir):
    tests = {
        "match": '(#match? @name "^A")', "eq": '(#match? @name "^(NATION_3|CHINA)$")', "any": '(#any-of? @value "1" "2" "30")', "not eq": '(#not-eq? @value "7")', "not match": '(#not-match? @name "A")',
    }
    out = None
    for name, test in tests.items():
        model = _model(raw=f"(assignment left: (identifier) @name right: (number) @value {test} (#not-eq? @name \"r\"))", name=str, value=int)
        rows = language_for("expr").extractor(model).extract(_assignments(spark, sf_dir)).select("doc_id", F.lit(name).alias("test"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, scope, COUNT(*) AS n FROM (SELECT n_regionkey, 'everywhere' AS scope FROM nation UNION ALL SELECT r_regionkey, 'everywhere' FROM region UNION ALL SELECT n_regionkey, 'strings' FROM nation) GROUP BY 1, 2")
def scoped_matches(spark, sf_dir):
    """Values of bindings in whole texts, and only inside string values (raw queries that look below chosen kinds)."""
    conf = language_for("conf")
    everywhere = conf.extractor(_model(raw="(binding value: [(string) (integer)] @v)", v=str)).rows(_conf_docs(spark, sf_dir))
    strings = conf.extractor(_model(raw="(string_content) @v", v=str)).rows(_conf_docs(spark, sf_dir), within="string")
    both = everywhere.select("doc_id", F.lit("everywhere").alias("scope")).unionByName(strings.select("doc_id", F.lit("strings").alias("scope")))
    return both.groupBy("doc_id", "scope").agg(F.count("*").alias("n"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(r_regionkey AS BIGINT) AS id FROM region")
def records_in_place(spark, sf_dir):
    """A record model for chosen nodes themselves, wherever they stand."""
    text = _text('{"list": [{"deep": {"id": ', F.col("r_regionkey"), "}}]}")
    docs = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text"))
    extractor = language_for("json").extractor(_model(M("document", "object", record=True), id=(int | None, None)), strict=False)
    nodes = language_for("json").nodes(docs, extractor.wanted())
    return extractor.of_records(nodes).where("id is not null").select("doc_id", "id")


# Changed texts, and texts of other encodings.


@query("SELECT event_id AS doc_id, TRUE AS same, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events")
def incremental_reparse(spark, sf_dir):
    """Each text is changed and parsed again with its old tree: the tree is that of a whole parse."""
    language = language_for("expr")
    sent = language._sent(spark)
    k = F.get_json_object("props", "$.k").cast("long")
    docs = _table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    docs = docs.select("event_id", "k", _text("a = 1; b = ", F.col("k"), "; c = f(2);").alias("old"), _text("a = 1; b = ", F.col("k") + 1, "; c = f(2);").alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _worker_parser(sent)
        for batch in batches:
            same, found = [], []
            for old, new in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tree, whole = parser.reparse(parser.parse(old, keep=True), new), parser.parse(new)
                same.append(same_trees(tree, whole))
                found.append(int(tree.children[1][1].child("right").text(new)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(found, pa.int64())], names=["doc_id", "same", "k"])

    return spread(docs).mapInArrow(run, "doc_id long, same boolean, k long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || 'é' AS name FROM nation")
def other_encodings(spark, sf_dir):
    """Texts that come as bytes in another encoding, which the extractor is told."""
    raw = F.encode(_text('{"name": "', F.col("n_name"), 'é"}'), "ISO-8859-1")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), raw.alias("text"))
    return language_for("json").extractor(_model(M("document", "object", record=True), name=str)).extract(docs, encoding="ISO-8859-1").select("doc_id", "name")


# Typed accessors.


@query("SELECT event_id AS doc_id, '\"k\"' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, 'Number' AS class FROM events")
def typed_accessors(spark, sf_dir):
    """The generated module, run over the trees of all events in the workers."""
    source, sent = accessors.generate_typed_api(language_for("json").schema, "json_api"), language_for("json")._sent(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        api: dict[str, Any] = {}
        exec(source, api)
        parser = _worker_parser(sent)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = api["wrap"](parser.parse(text), text)
                rows += [(doc, p.key.text, p.value.text, type(p.value).__name__) for o in tree.children("object") for p in o.children("pair")]
            names = ["doc_id", "key", "value", "class"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)

    return _events(spark, sf_dir).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key string, value string, class string")


# Grammar expressions, at work on texts.


def _tag_grammar() -> Grammar:
    g = Grammar("tags", start="source_file")
    g.rule("source_file", repeat(choice(ref("tag"), ref("loose"))))
    g.rule("tag", seq("@", alias(immediate_token(pattern("[A-Z]+")), "label")))
    g.rule("loose", choice("@", alias(pattern("[A-Z]+"), "loose_word")))
    return g


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'tag' ELSE 'loose' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS n FROM nation")
def immediate_tokens(spark, sf_dir):
    """@NAME without a blank is one tag, with a blank two loose parts; the name's node has an alias."""
    name = F.regexp_replace("n_name", "[^A-Z]", "")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("@"), name)).otherwise(F.concat(F.lit("@ "), name))
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    nodes = Language.load(_tag_grammar()).nodes(docs, Wanted(frozenset(("tag", "loose")), frozenset(), children=False))
    return nodes.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def _fork_grammar() -> Grammar:
    g = Grammar("forks", start="source_file")
    g.rule("source_file", choice(ref("plain"), ref("strong")))
    g.rule("plain", seq(ref("word"), ref("word")), dynamic=-1)
    g.rule("strong", seq(ref("word"), ref("word"), opt("!")), dynamic=5)
    g.rule("word", pattern("[A-Za-z0-9_]+"))
    g.conflict("plain", "strong")
    return g


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'strong' AS kind FROM nation")
def dynamic_precedence(spark, sf_dir):
    """Two ways to read a text: the one of higher dynamic precedence stays."""
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text("n", F.col("n_nationkey"), " r", F.col("n_regionkey")).alias("text"))
    nodes = Language.load(_fork_grammar()).nodes(docs, Wanted(frozenset(("plain", "strong")), frozenset(), children=False))
    return nodes.select("doc_id", "kind")


def _word_grammar() -> Grammar:
    g = Grammar("words", start="document")
    g.rule("document", repeat(choice(ref("call"), ref("member"))))
    g.rule("call", seq("do", field("name", ref("word"))))
    g.rule("member", seq(".", reserved("members", ref("word"))))
    g.rule("word", pattern("[a-z]+"), word=True)
    g.reserved_word("all", "if")
    g.reserved_word("members", "do")
    return g


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_nationkey % 4 IN (1, 2) AS broken FROM nation")
def reserved_contexts(spark, sf_dir):
    """``if`` is no word after do, and ``do`` none after a point; the other way round they are."""
    texts = F.element_at(F.array(*map(F.lit, (". if", "do if", ". do", "do x"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), texts.alias("text"))
    language = build(_word_grammar(), analyse=False).language()
    nodes = language.nodes(docs, Wanted(None, frozenset(), children=False))
    return nodes.groupBy("doc_id").agg(F.max(F.col("is_error") | F.col("is_missing")).alias("broken"))


# Rules as classes, over texts of suppliers.


class Note(rules.Extra, rules.Token):
    __body__ = seq("#", pattern(patterns.rest_of_line()))


class Number(rules.Pattern):
    __pattern__ = patterns.integer()


class NamePath(rules.Token):
    __pattern__ = patterns.dotted_path()


class Quoted(rules.Pattern):
    __pattern__ = patterns.quoted()


class FilePath(rules.Token):
    __body__ = prec(1, pattern(patterns.path_literal()))


class HTTPValue(rules.Supertype):
    __body__ = choice(rules.R(Number), rules.R(Quoted), rules.R(FilePath), ref("list"))


class ListRule(rules.Rule):
    __rule_name__ = "list"
    opening: Literal["["] = "["
    element: list[HTTPValue]
    closing: Literal["]"] = "]"


class Entry(rules.Rule):
    key: NamePath
    mark: Literal["=", ":"] = "="
    value: HTTPValue | None
    end: Literal[";"] = ";"


class SourceFile(rules.Rule):
    content: list[Entry]


def _class_grammar() -> Grammar:
    return rules.assemble("classes", start=SourceFile, rules=[Note, Number, NamePath, Quoted, FilePath, HTTPValue, ListRule, Entry, SourceFile])


@query("SELECT s_suppkey AS doc_id, k AS key, v AS value FROM supplier, (VALUES ('name'), ('at.nation'), ('dir'), ('none'), ('all')) x(k), LATERAL (SELECT CASE k WHEN 'name' THEN '\"' || s_name || '\"' WHEN 'at.nation' THEN CAST(s_nationkey AS VARCHAR) WHEN 'dir' THEN './s/' || s_suppkey WHEN 'all' THEN '[1 2]' END) y(v)")
def rule_classes(spark, sf_dir):
    """A grammar from classes (patterns, tokens, extras, supertypes, literals, lists, options) over texts of suppliers."""
    text = _text('name = "', F.col("s_name"), '"; # note\nat.nation: ', F.col("s_nationkey"), ";\ndir = ./s/", F.col("s_suppkey"), ";\nnone = ;\nall = [1 2];\n")
    docs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    model = _model(M("source_file", "entry"), key=str, value=(str | None, None))
    return Language.load(_class_grammar(), schema=False).extractor(model).extract(docs).select("doc_id", "key", "value")


def _condition_grammar() -> Grammar:
    g = Grammar("conditions", start="source_file")
    g.rule("source_file", repeat(ref("when")))
    g.rule("when", seq("if", field("test", ref("cond")), field("body", ref("block"))))
    g.rule("block", seq("{", opt(ref("expr")), "}"))
    g.rule("name", pattern("[a-z]+"), word=True)
    ladder = Ladder("sum", "call", "make")
    expression(g, "expr", primary=("name",), ladder=ladder, infix={"sum": ("+",)}, postfix={"make": ("made", lambda e: seq(e, "{", "}"))}, cond_primary="cond", cond_drops=("make",))
    return g


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'a + b' AS test, '{ c {} }' AS body FROM region")
def expression_conditions(spark, sf_dir):
    """In a condition the postfix form with braces is left out, so the braces after it are the block."""
    docs = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("if a + b { c {} }").alias("text"))
    model = _model(M("source_file", "when"), test=str, body=str)
    return Language.load(_condition_grammar(), schema=False).extractor(model).extract(docs).select("doc_id", "test", "body")


# Trees as texts.


@query(
    r"""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '(document (object "{" (pair key: (string "\"" (string_content) "\"") ":" value: (number)) "}"))' AS kept, '(document (object (pair (string (string_content)) (number))))' AS dropped FROM nation"""
)
def render_sexp(spark, sf_dir):
    """Canonical forms: anonymous tokens quoted by kind and fields shown, or tokens left out."""
    text = _text('{"', F.col("n_name"), '": ', F.col("n_nationkey"), "}")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    kept = render.rendered(docs, language_for("json"), fields=True).withColumnRenamed("rendered", "kept")
    return render.rendered(kept, language_for("json"), anonymous="drop").select("doc_id", "kept", F.col("rendered").alias("dropped"))


# Scanners, over texts of tables.


def _indented(scanner: str):
    g = Grammar(f"g_{scanner}", default_whitespace=False)
    g.external("NEWLINE", "INDENT", "DEDENT")
    g.extra(pattern(r"[ \t]"))
    if scanner == "py_indent":
        g.extra(pattern(r"#[^\n]*"))
        g.extra(pattern(r"\\\n"))
    g.rule("source_file", repeat(ref("statement")))
    g.rule("statement", seq(field("name", ref("word")), choice(ref("NEWLINE"), seq(":", ref("NEWLINE"), ref("INDENT"), repeat1(ref("statement")), ref("DEDENT")))))
    g.rule("word", pattern("[A-Za-z0-9_]+"))
    return build(g, scanner=scanner, analyse=False).language()


def _outline(spark, sf_dir, lead: str = "") -> DataFrame:
    """One text for each region, its nations indented below it."""
    one = _text("  n", F.col("n_nationkey"), lead, "\n")
    texts = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("t")))), lambda s: s["t"]), "")
    return texts.agg(body.alias("body")).select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(":\n"), "body", F.lit("end\n")).alias("text"))


_OUTLINE = "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'n' || n_nationkey AS name, CAST(2 AS BIGINT) AS depth FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'r' || r_regionkey, CAST(1 AS BIGINT) FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'end', CAST(1 AS BIGINT) FROM region"


def _statements(language: Language, docs: DataFrame) -> DataFrame:
    nodes = language.nodes(docs, Wanted(frozenset(("statement",)), frozenset()))
    name = F.try_element_at(F.filter("children", lambda c: c["field"] == "name"), F.lit(1))["text"]
    return nodes.select("doc_id", name.alias("name"), F.col("depth").cast("long").alias("depth"))


@query(_OUTLINE)
def scanner_indent(spark, sf_dir):
    return _statements(_indented("indent"), _outline(spark, sf_dir))


@query(_OUTLINE)
def scanner_py_indent(spark, sf_dir):
    """Comment and blank lines of any indentation count for nothing, and a tab is eight columns."""
    return _statements(_indented("py_indent"), _outline(spark, sf_dir, "  # a note\n\n# another\n"))


def _heredocs(scanner: str):
    g = Grammar(f"h_{scanner}")
    g.external("HEREDOC_START", "HEREDOC_BODY")
    g.rule("source_file", repeat(ref("heredoc")))
    g.rule("heredoc", seq("<<", field("start", ref("HEREDOC_START")), field("body", ref("HEREDOC_BODY"))))
    return build(g, scanner=scanner, analyse=False).language()


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'END' AS start, n_name || chr(10) || 'ENDING' || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) ELSE chr(10) || 'END' END AS body FROM nation")
def scanner_heredoc(spark, sf_dir):
    """Bodies go up to and with the line that is the delimiter, or to the end of the text."""
    tail = F.when(F.col("n_nationkey") % 5 == 0, "\n").otherwise("\nEND")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text("<< END\n", F.col("n_name"), "\nENDING", tail).alias("text"))
    return _heredocs("heredoc").extractor(_model(M("source_file", "heredoc"), start=str, body=str)).extract(docs).select("doc_id", "start", "body")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, s AS start, b AS body FROM nation, (VALUES ('A'), ('''B''')) x(s), LATERAL (SELECT CASE s WHEN 'A' THEN n_name || chr(10) || 'A' ELSE chr(9) || 'two' || chr(10) || chr(9) || 'B' END) y(b)")
def scanner_queued_heredocs(spark, sf_dir):
    """Two heredocs begun on one line, the second with tabs to strip and a quoted delimiter."""
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text("cat <<A <<-'B'\n", F.col("n_name"), "\nA\n\ttwo\n\tB\nX=1\n").alias("text"))
    g = Grammar("queued", default_whitespace=False)
    g.external("QUEUED_START", "QUEUED_BODY")
    g.extra(pattern(r"[ \t]"))
    g.rule("source_file", repeat(choice(ref("line"), ref("setting"))))
    g.rule("line", seq(ref("word"), repeat1(ref("QUEUED_START")), "\n", repeat1(seq(ref("QUEUED_BODY"), "\n"))))
    g.rule("setting", seq(ref("word"), "=", ref("word"), "\n"))
    g.rule("word", pattern("[A-Za-z0-9]+"))
    language = build(g, scanner="queued_heredoc", analyse=False).language()
    wanted = frozenset(("QUEUED_START", "QUEUED_BODY"))
    nodes = language.nodes(docs, Wanted(wanted, wanted, children=False))
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("node_id"))
    kinds = nodes.where("named").select("doc_id", "kind", "text", nth.alias("nth"))
    starts = kinds.where("kind = 'QUEUED_START'").select("doc_id", "nth", F.regexp_replace("text", "^<<-?", "").alias("start"))
    return starts.join(kinds.where("kind = 'QUEUED_BODY'").select("doc_id", "nth", F.col("text").alias("body")), ["doc_id", "nth"]).select("doc_id", "start", "body")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 4 = 0 THEN '(b (' || n_regionkey || '))' ELSE '(' || n_name || ' (b (' || n_regionkey || ')) c)' END AS token FROM nation")
def scanner_matched(spark, sf_dir):
    """One token from a bracket to the one that closes it; one that never closes is refused, those inside it are not."""
    g = Grammar("matched")
    g.external("MATCHED")
    g.rule("source_file", repeat(choice(ref("MATCHED"), ref("word"))))
    g.rule("word", pattern("[A-Za-z0-9_]+"))
    end = F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(") d")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text("a (", F.col("n_name"), " (b (", F.col("n_regionkey"), ")) c", end).alias("text"))
    nodes = build(g, scanner="matched_delimiter", analyse=False).language().nodes(docs, Wanted(frozenset(("MATCHED",)), frozenset(("MATCHED",)), children=False))
    return nodes.where("not is_error and not is_missing").select("doc_id", F.col("text").alias("token"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '$ \\\" x ' AS fragment FROM nation")
def scanner_fragment(spark, sf_dir):
    """The text of a quoted string up to an interpolation; escapes and lone dollars are part of it."""
    g = Grammar("fragments")
    g.external("string_fragment")
    g.rule("source_file", repeat(ref("string")))
    g.rule("string", seq('"', repeat(choice(ref("string_fragment"), ref("hole"))), '"'))
    g.rule("hole", seq("${", ref("word"), "}"))
    g.rule("word", pattern("[a-z]+"))
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), _text('"', F.col("n_name"), '$ \\" x ${who}"').alias("text"))
    nodes = build(g, scanner="fragment", analyse=False).language().nodes(docs, Wanted(frozenset(("string_fragment",)), frozenset(("string_fragment",)), children=False))
    return nodes.select("doc_id", F.col("text").alias("fragment"))


# Tokens of whole documents.


@query(r"WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[\p{L}\p{N}]+')) AS w FROM documents) SELECT CASE WHEN contains(w, '@') THEN 'email' WHEN regexp_full_match(w, '[0-9]+') THEN 'number' ELSE 'word' END AS kind, COUNT(*) AS n FROM t GROUP BY 1")
def doc_tokens_all_kinds(spark, sf_dir):
    """Words, numbers and addresses of all documents, by kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    nodes = language_for("tokens").nodes(docs, Wanted(frozenset(("email", "number", "word")), frozenset(), children=False, places=False))
    return nodes.where("not is_error").groupBy("kind").agg(F.count("*").alias("n"))
