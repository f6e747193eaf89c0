"""Texts that are left out before they are parsed."""

import re
from typing import Annotated

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syntaxframe.language import language_for
from syntaxframe.model import AnyOf, Eq, M, Matches, OutputModel, Unescaped
from syntaxframe.plans.extract import field_rows, record_rows
from syntaxframe.plans.skip import can_give_rows, fixed_part


@pytest.mark.parametrize(
    "pattern, part",
    [
        ("abc", "abc"), ("^abc$", "abc"), ("ab?cd", "cd"), ("ab+cd", "ab"), ("a.bcd", "bcd"), (r"\d+foo\.bar\s*", "foo.bar"), ("x(yz)?abc[d-f]+g", "abc"), ("a|b", None),
        ("(?i)abc", None), ("(a|b)cde", "cde"), (r"\u0041bc", None), ("a{2,3}bc", "bc"), ("[[a]b]xyz", None), ("[]a]xyz", None), ("", None), (".*", None), (r"\p{L}+abc", "abc"),
        ("(?:no|yes)well", "well"), ("a**", None), ("ab(", None), ("ab\\", None), ("(?<name>a)bc", None), ("a+?bc", "bc"),
    ],
)
def test_fixed_parts(pattern, part):
    assert fixed_part(pattern) == part


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.?*+()[]{}|^$\\d2,", max_size=9), st.text(alphabet="ab2.d", max_size=6))
def test_every_match_contains_the_fixed_part(pattern, text):
    part = fixed_part(pattern)
    try:
        found = re.search(pattern, text)
    except (re.error, RecursionError):
        return
    if part is not None and found is not None:
        assert part in text


TEXTS = [
    '{"k": "12"}', '{"k": 12}', '{"k": 112}', '{"k": "1\\u0032"}', '{"j": 12}', '{"k": 1, "j": [12]}', '{"k": "a.b"}', '{"k": "axb"}', "", None, "[1, 2", '{"k": 13} {"k": 12}', '{"k": "tab\\t12"}',
]


class One(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[str | int, Eq("12")]


class Many(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[str | int, AnyOf("12", "13")]
    j: str | None


class Pattern(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[str, Matches(r"^a\.b$")]


class Loose(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[int | None, Eq("12")]


class Decoded(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[str, Unescaped(), Eq('"12"')]


@pytest.mark.parametrize("model, skips", [(One, True), (Many, True), (Pattern, True), (Loose, False), (Decoded, False)])
def test_rows_are_those_of_all_texts(spark, model, skips):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    extractor = language_for("json").extractor(model, strict=False)
    assert (can_give_rows(extractor.checked, docs["text"]) is not None) == skips
    got = extractor.rows(docs)
    nodes = language_for("json").nodes(docs, extractor.wanted())
    whole = (record_rows if extractor.spec.record else field_rows)(nodes, extractor.checked, ["doc_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_the_reader_sees_the_test(spark, tmp_path):
    spark.createDataFrame([(k, f'{{"k": {k}}}') for k in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = language_for("json").extractor(One).extract(spark.read.parquet(str(tmp_path / "t")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Contains(text")
    assert "StringContains(text,12)" in plan
    assert sorted(r.doc_id for r in rows.collect()) == [12]


def test_a_parse_for_several_models_skips_what_none_needs(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    language = language_for("json")
    both = [language.extractor(One, strict=False), language.extractor(Pattern, strict=False)]
    nodes = language.shared_nodes(docs, both)
    assert nodes.select("doc_id").distinct().count() < docs.where("text is not null").count()
    for e in both:
        assert sorted(map(str, e.extract_nodes(nodes).drop("node_id").collect())) == sorted(map(str, e.extract(docs).drop("node_id").collect()))
