"""Models, bind-time checks and plans."""

import random
import re
from typing import Annotated

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syntaxframe.errors import ExtractionError, QueryBuildError, SchemaCheckError, ShapeError
from syntaxframe.functions import coerce
from syntaxframe.language import Language, language_for
from syntaxframe.model import Eq, M, Matches, NodeKind, OutputModel, RawQuery, Span, Unescaped, capture, capture_kind, derived, source_meta
from syntaxframe.operators import reparse
from syntaxframe.parse.rows import Wanted, tree_rows
from syntaxframe.plans.paths import matches_chain
from syntaxframe.valuemap import ValueMap

PEOPLE = """[
  {"name": "ann", "age": 30, "tags": ["x", "y"], "nick": "a"},
  {"age": 41, "name": "ben", "tags": [], "active": true, "home": {"city": "Rome", "name": "inner"}},
  {"name": "cy", "age": 2, "tags": [""]}
]"""


class Home(OutputModel):
    __match__ = M("document", ..., "object", record=True)
    city: str


class Person(OutputModel):
    __match__ = M("document", "array", "object", record=True)
    name: str
    age: int
    tags: list[str]
    nick: str | None = None
    active: bool = False
    home: Home | None = None
    line: int = source_meta()


def test_people(spark):
    got = [p.model_dump() for p in Person.extract(PEOPLE, language="json")]
    assert got == [
        {"name": "ann", "age": 30, "tags": ["x", "y"], "nick": "a", "active": False, "home": None, "line": 2},
        {"name": "ben", "age": 41, "tags": [], "nick": None, "active": True, "home": {"city": "Rome"}, "line": 3},
        {"name": "cy", "age": 2, "tags": [], "nick": None, "active": False, "home": None, "line": 4},
    ]


def test_strict_and_lenient(spark):
    bad = PEOPLE.replace("41", '"old"')
    assert [p.name for p in Person.extract(bad, language="json", strict=False)] == ["ann", "cy"]
    with pytest.raises(ExtractionError) as caught:
        Person.extract(bad.replace('"age": 2', '"age": 2.5'), language="json")
    assert [f.line for f in caught.value.failures] == [3, 4] and "age" in str(caught.value)
    docs = spark.createDataFrame([(1, bad), (2, None), (3, "")], "doc_id long, text string")
    with pytest.raises(Exception, match="missing at line 3"):
        Person.extract(docs, language="json").collect()
    assert language_for("json").extractor(Person).failures(docs).select("doc_id").collect()[0][0] == 1


def test_predicates_in_records(spark):
    class Adult(OutputModel):
        __match__ = M("document", "array", "object", record=True)
        name: Annotated[str, Matches("^[ab]")]
        age: Annotated[int | None, Eq("30")] = None

    assert [(p.name, p.age) for p in Adult.extract(PEOPLE, language="json")] == [("ann", 30), ("ben", None)]


def test_unescaped_and_split_strings(spark):
    class Plain(OutputModel):
        __match__ = M("document", "object", record=True)
        s: Annotated[str, Unescaped()]

    text = r'{"s": "a\n\t\"\\\u00e9\/"}'
    assert Plain.extract(text, language="json")[0].s == 'a\n\t"\\é/'
    assert Plain.extract(r'{"s": "a\qb\n\u12"}', language="json")[0].s == "a\\qb\n\\u12"
    assert Plain.extract('{"s": ""}', language="json")[0].s == ""


class Fn(OutputModel):
    __match__ = M("source_file", ..., "call")
    function: Annotated[str, Matches("^[a-z]+$")]
    args: list[str] = capture("argument")
    where: Span = source_meta()


def test_field_mode_lists_and_spans(spark):
    text = "é = 1;\nx = -f(a, 2) + g();"
    rows = Fn.extract(text.replace("é", "e"), language="expr")
    assert [(r.function, r.args) for r in rows] == [("f", ["a", "2"]), ("g", [])]
    assert (rows[0].where.line, rows[0].where.column, rows[0].where.text) == (2, 5, "f(a, 2)")


def test_captures_follow_the_order_of_declaration(spark):
    class Two(OutputModel):
        __match__ = M("source_file", "expression_statement", "call")
        first: str = capture("argument")
        second: str = capture("argument")

    assert [(r.first, r.second) for r in Two.extract("f(a, b); g(c);", language="expr")] == [("a", "b")]
    with pytest.raises(ExtractionError, match="ambiguous"):
        Two.extract("f(a, b, c);", language="expr")

    class Twice(OutputModel):
        __match__ = M("source_file", "assignment")
        a: str = capture("left")
        b: str = capture("left")

    with pytest.raises(QueryBuildError):
        language_for("expr").extractor(Twice)


def test_optional_and_kinds(spark):
    class Value(OutputModel):
        __match__ = M("source_file", "assignment")
        name: str = capture("left")
        value: Annotated[str | None, NodeKind("number", "identifier")] = capture("right")
        kind: str = derived("assignment")

    got = Value.extract("a = 1; b = c; d = 1 + 2;", language="expr")
    assert [(r.name, r.value, r.kind) for r in got] == [("a", "1", "assignment"), ("b", "c", "assignment"), ("d", None, "assignment")]


def test_raw_queries(spark):
    class Pair(OutputModel):
        __raw_query__ = RawQuery('(binary left: [(identifier) (number)] @l operator: "+" right: (_)? @r (#not-eq? @l "z")) ; note')
        l: str
        r: str | None
        line: int = source_meta()

    assert [(p.l, p.r, p.line) for p in Pair.extract("a + b;\nz + 1; 2 + (c); 1 * 2;", language="expr")] == [("a", "b", 1), ("2", "(c)", 2)]
    for bad in ("(a", "(a) @x (#odd? @x)", "", "(a (#eq? @nope \"x\"))", "(a .)"):
        with pytest.raises(QueryBuildError):
            from syntaxframe.plans.raw import parse_query

            parse_query(bad)
    lists = type("L", (OutputModel,), {"__annotations__": {"x": list[str]}, "__raw_query__": RawQuery("(call function: (_) @f argument: (_)* @x)")})
    assert [r.x for r in lists.extract("f(a, b); g();", language="expr")] == [["a", "b"], []]


def test_checks_before_any_job(spark):
    json, expr = language_for("json"), language_for("expr")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    def refused(error, language, path, annotations, **values):
        with pytest.raises(error):
            language.extractor(type("X", (OutputModel,), {"__match__": path, "__annotations__": annotations, **values}))

    refused(SchemaCheckError, json, M("nope"), {"a": str})
    refused(SchemaCheckError, json, M("pair", "document"), {"key": str})
    refused(SchemaCheckError, json, M("string", ..., "object"), {"a": str})
    refused(SchemaCheckError, expr, M("assignment"), {"middle": str})
    refused(SchemaCheckError, expr, M("assignment"), {"x": str}, x=capture_kind("document"))
    refused(SchemaCheckError, json, M("document", "object", "pair"), {"value": Annotated[int, NodeKind("string")]})
    refused(ShapeError, json, M("document", "array", record=True), {"a": str})
    refused(ShapeError, json, M("object", record=True, record_pair="array"), {"a": str})
    refused(ShapeError, language_for("ini"), M("source_file", "section", record=True), {"a": str})
    ini = language_for("ini").with_schema(language_for("ini").schema, ValueMap({"integer": "int"}))
    refused(ShapeError, ini, M("source_file", "section", record=True), {"a": int})
    refused(ShapeError, ini, M("source_file", "section", record=True, record_pair="entry"), {"a": float | None, "b": bool})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    empty = type("D", (OutputModel,), {"__match__": M("document"), "__annotations__": {"d": str}, "d": derived()})
    assert len(empty.validate_with("json")) == 1


def test_declarations_are_checked():
    for bad in (lambda: M(), lambda: M(..., "a"), lambda: M("a", ...)):
        with pytest.raises(ShapeError):
            bad()
    with pytest.raises(TypeError):
        M(1)
    with pytest.raises(ShapeError):
        type("B", (OutputModel,), {"__match__": M("a"), "__raw_query__": RawQuery("(a)"), "__annotations__": {}})
    with pytest.raises(ShapeError):
        type("N", (OutputModel,), {"__match__": M("a"), "__annotations__": {"p": Person}})
    with pytest.raises(ShapeError):
        type("F", (OutputModel,), {"__match__": M("a"), "__annotations__": {"p": "Nowhere"}})
    with pytest.raises(ShapeError):
        OutputModel.spec()
    assert "(object" in Person.compiled_source() and '"age": [(' not in Person.compiled_source()
    child = type("Child", (Person,), {"__annotations__": {"extra": str}})
    assert [b.name for b in child.spec().bindings][-1] == "extra" or "extra" in [b.name for b in child.spec().bindings]


def test_languages_and_caches():
    json = Language.load("json")
    assert json.extractor(Person) is json.extractor(Person) and json.extractor(Person) is not json.extractor(Person, strict=False)
    assert Language.load("json", schema=False).schema is None and language_for("json") is language_for("json")
    loose = Language.load("json", schema=False).extractor(Person)
    assert loose.checked.pair_kinds == ("pair",)


# Paths against a plain matcher.


def plain_match(chain, steps):
    if not steps:
        return True
    *rest, last = steps
    if last == "...":
        return any(plain_match(chain[:k], rest) for k in range(len(chain) + 1))
    return bool(chain) and chain[-1] in last and plain_match(chain[:-1], rest)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.one_of(st.just("..."), st.sampled_from([("a",), ("b",), ("a", "c")])), max_size=5))
def test_paths_are_regular_expressions(chain, middle):
    path = M("a", *[... if s == "..." else s for s in middle], ("a", "b"))
    assert matches_chain(chain, path) == (chain[-1] in ("a", "b") and plain_match(chain[:-1], list(path.steps[:-1])))


# Conversions.


def test_conversions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123 +-._eE") for _ in range(rng.randint(0, 5))) for _ in range(300)] + ["nan", "inf", "-Infinity", "9223372036854775807"]

    def as_int(t):
        s = t.strip()
        return int(re.sub(r"\.0+$", "", s).replace("_", "")) if re.fullmatch(r"[+-]?\d+(_\d+)*(\.0+)?", s) else None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", coerce.to_int(F.col("t")).alias("i"), coerce.to_float(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r.i == as_int(r.t), r
        if r.f is not None:
            assert str(float(r.t.strip().replace("_", ""))) == str(r.f)


# Rows.


def test_rows_and_byte_places():
    text = '{"é": ["☃", 1]}\n'
    rows = {(r[6], r[11], r[12]): r for r in tree_rows(language_for("json").parse(text), text, Wanted())}
    raw = text.encode()
    for (kind, start, end), r in rows.items():
        if r[18] is not None:
            assert raw[start:end].decode() == r[18]
        assert r[0] <= r[1] and r[17].count("/") == r[3]
    assert ("document", 0, len(raw)) in rows and any(k == "number" for k, _, _ in rows)


def test_edits_against_brute_force(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("a", ""), ("", "é"), ("aaa", "aa")] + [("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    rows = reparse.with_edit(spark.createDataFrame(pairs, "old string, new string"), "old", "new").collect()
    for r in rows:
        head = next((i for i, (x, y) in enumerate(zip(r.old, r.new)) if x != y), min(len(r.old), len(r.new)))
        a, b = r.old[head:][::-1], r.new[head:][::-1]
        tail = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.start, r.old_end, r.new_end) == (head, len(r.old) - tail, len(r.new) - tail)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r.doc_id for r in reparse.changed(docs, spark.createDataFrame([(1, "a"), (2, "c"), (3, "b")], docs.schema)).orderBy("doc_id").collect()] == [2, 3]


def test_plans_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "{}")], "doc_id long, text string")
    for model, language in ((Person, "json"), (Fn, "expr")):
        plan = model.extract(docs, language=language)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" in plan


def test_steps_of_a_plan_are_not_written_out_at_each_use(spark):
    """Conditions stay above the steps that they look at: two captures took a thousand lambdas when they were moved down."""

    class TwoSides(OutputModel):
        __match__ = M("source_file", "assignment")
        name: str = capture("left")
        value: int = capture("right")

    docs = spark.createDataFrame([(1, "a = 1; b = 2;"), (2, "c = 3;")], "doc_id long, text string")
    rows = TwoSides.extract(docs, language="expr").select("doc_id", "value")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") < 60
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1), (1, 2), (2, 3)]


def test_whole_numbers_of_odd_spelling(spark):
    from pyspark.sql import functions as F

    from syntaxframe.functions.coerce import to_int

    texts = {"7": 7, "007": 7, "1.5": None, "5.0": 5, "1_0": 10, "1 0": None, "1e5": None, "\x015": None, "5\x7f": None, " 5 ": 5, "+5": 5, "-5": -5, "": None, "٣": None, "9" * 18: 10**18 - 1, "9" * 19: None, "1-1": None}
    rows = spark.createDataFrame(list(texts.items()), "t string, n long").withColumn("got", to_int(F.col("t")))
    assert {r.t: r.got for r in rows.collect()} == texts
