"""Lists of tokens made in the JVM, against the parser."""

import re
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from syntaxframe.grammar.dsl import Grammar, choice, field, pattern, prec, ref, repeat, seq, token
from syntaxframe.language import Language, language_for
from syntaxframe.parse.rows import COLUMNS, Wanted, parse_batches
from syntaxframe.plans.flat import flat, flat_nodes, jvm_sets

TEXTS = [
    None, "", "\n", "a", "a\n\nb é\n", "x" * 300 + "\n" + "y z " * 500, "mail a.b@c.de, x@y.z.w! 12 12a a12 ½ ² Ⅷ _ __ a_b\t\r\n\x0b\x1c  end", "日本語 テキスト１２ ①\n😀 é ‿\n",
    "@@..a@b.c.d" + ".e" * 9000, "1 " * 3000, "no-break\x85x", "\n" * 200, "a@b a@b.c_d 7%",
]


def parsed(language, docs, want):
    sent = language._sent(docs.sparkSession)
    from syntaxframe.language import _worker_parser

    return docs.mapInArrow(lambda batches: parse_batches(batches, _worker_parser(sent).parse, want, ["doc_id"]), "doc_id long, " + COLUMNS)


@pytest.mark.parametrize("name, kinds", [("lines", {"line"}), ("lines", {"content"}), ("lines", {"line", "content", "\n"}), ("tokens", {"email"}), ("tokens", {"email", "number", "word", "mark"}), ("tokens", {"nothing"})])
@pytest.mark.parametrize("text, children", [(None, True), (frozenset(), False), (frozenset(("line", "word")), True)])
def test_rows_are_those_of_the_parser(spark, name, kinds, text, children):
    language, want = language_for(name), Wanted(frozenset(kinds), text, children=children)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got, expected = language.nodes(docs, want), parsed(language, docs, want)
    assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (name == "tokens")
    assert got.schema == expected.schema or [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in expected.schema]
    order = lambda df: sorted((str(r) for r in df.collect()))
    assert order(got) == order(expected)
    bare, kept = language.nodes(docs, replace(want, places=False)), ["doc_id", "kind", "named", "path", "text", "is_error"]
    assert "MapInArrow" not in bare._jdf.queryExecution().executedPlan().toString()
    assert order(bare.select(*kept)) == order(expected.select(*kept))


def test_places_of_short_tokens(spark):
    """They are right as well, though the parser is asked for them."""
    want = Wanted(frozenset({"email", "number", "word", "mark"}))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = flat_nodes(docs, language_for("tokens").flat, want, ["doc_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, parsed(language_for("tokens"), docs, want).collect()))


def test_classes_have_the_same_members_in_both_languages(spark):
    """Every character: letters, digits and white space are the same for the parser and for the JVM."""
    sets = jvm_sets(spark)
    points = spark.range(sys.maxunicode + 1).where("id < 55296 or id > 57343")
    tested = points.select("id", *(F.expr(f"rlike(decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), '^[{members}]$')".replace("\\", "\\\\")).alias(k) for k, members in sets.items()))
    found = {k: {r.id for r in tested.where(k).select("id").collect()} for k in sets}
    for k in sets:
        own = {c for c in [*range(0xD800), *range(0xE000, sys.maxunicode + 1)] if re.fullmatch(rf"\{k}", chr(c)) and chr(c) != "\n"}
        assert own - found[k] == set() and found[k] - {10} - own == set(), (k, sorted(own ^ found[k])[:20])


def grammar(*members, **rules):
    g = Grammar("g", default_whitespace=False, start="document")
    g.rule("document", repeat(choice(*members)))
    for name, body in rules.items():
        g.rule(name, body)
    return Language.load(g)


def test_what_is_no_list_of_tokens_is_left_to_the_parser():
    assert language_for("lines").flat and language_for("tokens").flat
    assert not any(language_for(n).flat for n in ("json", "ini", "conf", "expr", "html", "shell"))
    # Some texts have errors; two runs that begin alike; nodes of two tokens.
    assert grammar(ref("word"), word=pattern("[a-z]+")).flat is None
    assert grammar(ref("a"), ref("b"), a=pattern("[^x]+"), b=pattern("[^y]+")).flat is None
    assert grammar(ref("a"), ref("b"), a=seq(ref("c"), ref("c")), b=pattern(r"[\d]"), c=pattern(r"[^\d]")).flat is None
    # By precedence, the same two are one.
    assert grammar(ref("a"), ref("b"), a=token(prec(1, pattern("[^x]+"))), b=pattern("[^y]+")).flat is not None


def test_wrapped_tokens_beside_bare_ones(spark):
    language = grammar(ref("row"), ref("gap"), row=field("cell", ref("cell")), cell=pattern(r"[^\s,]+"), gap=pattern(r"[\s,]"))
    assert flat(language.tables) is not None
    want = Wanted(frozenset(("row", "gap", "cell")))
    docs = spark.createDataFrame([(1, "a, é\nb,,c"), (2, "\n\nx")], "doc_id long, text string")
    assert sorted(map(str, language.nodes(docs, want).collect())) == sorted(map(str, parsed(language, docs, want).collect()))
