"""Texts of a known shape: rows and matches are those of the parser, made without it."""

import random

import pyarrow as pa
import pytest

from syntaxframe.language import language_for
from syntaxframe.parse.rows import Wanted, parse_batches
from syntaxframe.parse.runtime import Parser
from syntaxframe.parse.shapes import Shapes, learnt
from syntaxframe.plans.raw import match_batches

PIECES = {
    "expr": ["a", "b1", "not", "and", "andy", "1", "2.5", " ", "  ", "\n", "+", "-", "*", "=", ";", "(", ")", "f(2)", "x = 1;", "<", "<=", "# c\n", "é", "."],
    "json": ['{"k": 7}', '{"k":-1.5}', '{"a": [1, {"b": "x y"}]}', '{"n": null, "k": "q"}', "[", "]", "{", "}", '"', " ", "\n", ",", ":", "true", "1", "01", '"\\n"', '"é"'],
    "ini": ["[s]", "\n", "a = 1", "a=", "b", " ", ";c\n", "#", "é"],
    "conf": ["a", " ", "=", "1", '"x"', "{", "}", "\n", "b = 2\n"],
}


def texts_of(language, seed, n=400):
    rng, out = random.Random(seed), []
    for _ in range(n):
        out += ["".join(rng.choices(PIECES[language], k=rng.randrange(6)))] * 2
    if language == "expr":
        out += [f"v{rng.randrange(99)} = {rng.randrange(99)};{rng.choice(['', chr(10), ' '])}w = {rng.random()};" for _ in range(n)]
    if language == "json":
        out += [rng.choice(['{"k": %d}', '{"k":%d}', '{\n "k": [%d, {"z": 1}]}\n', '{"long key": %d}']) % rng.randrange(999) for _ in range(n)]
    rng.shuffle(out)
    return [*out, None, ""]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["d", "text"])


def rows(batches):
    return sorted((str(r) for b in batches for r in b.to_pylist()))


@pytest.mark.parametrize("language", PIECES)
def test_rows_are_those_of_the_parser(language):
    parser, texts = Parser(language_for(language).tables), texts_of(language, 1)
    known = Shapes(parser)
    for want in (Wanted(), Wanted(frozenset(("object", "assignment", "pair")), frozenset(("assignment",)), {"string": ("string_content",)}, frozenset(("pair",)), {"string": ("string_content",)}, True)):
        got = parse_batches([batch(texts)], parser.parse, want, ["d"], known.find)
        assert rows(got) == rows(parse_batches([batch(texts)], parser.parse, want, ["d"]))
    if language in ("expr", "json"):
        assert any(shapes for _, shapes in known.held.values())


@pytest.mark.parametrize("query", ["(number) @n", '(binary left: (_) @a "+" @plus)', '(assignment left: (identifier) @name right: (number) @n (#match? @name "^v1"))', '(identifier) @n (number) @n'])
def test_matches_are_those_of_the_parser(query):
    texts = texts_of("expr", 2)
    fast, slow = Parser(language_for("expr").tables), Parser(language_for("expr").tables)
    slow.shapes = Shapes(slow)
    slow.shapes.able = False
    declared = ["n", "a", "name", "plus"]
    assert rows(match_batches([batch(texts)], fast, query, declared, ["d"])) == rows(match_batches([batch(texts)], slow, query, declared, ["d"]))


def test_texts_of_one_shape_are_parsed_a_few_times_only(monkeypatch):
    parser, calls = Parser(language_for("expr").tables), []
    parse = parser.parse
    monkeypatch.setattr(parser, "parse", lambda text: calls.append(text) or parse(text))
    texts = [f"{i}.0 + {i * 7} * 0.{i};" for i in range(1000)]
    assert sum(b.num_rows for b in match_batches([batch(texts)], parser, "(binary) @b", ["b"], ["d"])) == 2000
    assert len(calls) <= 2


def test_tokens_with_another_choice_are_left_to_the_lexer():
    parser = Parser(language_for("expr").tables)
    shape = learnt(parser, "a = 1;")
    assert shape.match("bb = 23;") and not shape.match("a =1;") and not shape.match("é = 1;")
    # A word that could be a keyword, or begins like one.
    assert not shape.match("not = 1;")
    assert learnt(parser, "a = ;") is None and learnt(parser, "# c\na = 1;") is None
