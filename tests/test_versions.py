"""Streams of versions: trees from the state against those of whole parses."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syntaxframe.language import language_for
from syntaxframe.model import M, OutputModel, Span, capture, source_meta
from syntaxframe.parse.frozen import freeze, frozen_marks, frozen_root, thawed
from syntaxframe.streaming import versions as V

SCHEMA = "doc_id long, version long, text string"


class Assignment(OutputModel):
    __match__ = M("source_file", "assignment")
    name: str = capture("left")


class Named(OutputModel):
    __match__ = M("document", "object", record=True)
    name: str


def shape(tree):
    return [(n.kind, n.named, n.start, n.end, n.extra, n.error, n.missing, len(n.children), [f for f, _ in n.children]) for n in tree.walk()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a = 1;", "b = f(2, x);", "é = (1 + 2) * 3;", "}", "", "c = ", "# note\n", "d=-1;"]), max_size=8), st.data())
def test_frozen_trees_are_the_trees(parts, data):
    parser, text = language_for("expr").parser(), " ".join(parts)
    tree = parser.parse(text, keep=True)
    again = thawed(frozen_root(tree), [freeze(f, n) for f, n in tree.children], text, frozen_marks(tree))
    assert shape(again) == shape(tree) and again.marks == tree.marks
    at = data.draw(st.integers(0, len(text)))
    changed = text[:at] + data.draw(st.sampled_from(["", "7", "x", "g = 9; ", "("])) + text[at + data.draw(st.integers(0, 3)) :]
    assert shape(parser.reparse(again, changed)) == shape(parser.parse(changed))


def edits(seed, docs=6, versions=8, size=40):
    rng, rows = random.Random(seed), []
    for doc in range(docs):
        parts = [f"v{i} = {i} + f(x);" for i in range(size)]
        for version in range(1, versions + 1):
            parts[rng.randrange(size)] = rng.choice([f"w{version} = {rng.random():.3f};", "", "é = (", "k = 1; l = 2;"])
            rows.append((doc, version, "\n".join(parts)))
    rng.shuffle(rows)
    return rows


def test_versions_in_any_order_give_the_nodes_of_whole_parses(spark, tmp_path):
    language, rows = language_for("expr"), edits(1)
    out = V.replay(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/s", language, 1)
    assert sorted((r.doc_id, r.version, r.text) for r in out.collect()) == sorted(rows)
    whole = spark.createDataFrame(rows, SCHEMA)
    got, want = V.version_nodes(out).drop("parsed_chars"), language.nodes(whole)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    model = language.extractor(Assignment, strict=False)
    names = sorted((r.doc_id, r.version, r.name) for r in V.extract_versions(out, model).collect())
    assert names == sorted((r.doc_id, r.version, r.name) for r in model.extract(whole).collect()) and names


def test_only_what_changed_is_parsed(spark, tmp_path):
    text = "\n".join(f"v{i} = {i} + f(x);" for i in range(200))
    rows = [(1, 1, text)] + [(1, v, text.replace(f"v{v * 30} =", f"w{v} =")) for v in range(2, 6)] + [(1, 6, text.replace("v150 =", "w5 ="))]
    out = V.replay(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/s", language_for("expr"))
    parsed = {r.version: r.parsed_chars for r in out.collect()}
    assert parsed[1] == len(text) and parsed[6] == 0
    assert all(parsed[v] < len(text) * 0.35 for v in range(2, 6))


def test_state_outlives_the_stream(spark, tmp_path):
    folder, language = f"file://{tmp_path}/s", language_for("expr")
    text = " ".join(f"v{i} = {i};" for i in range(100))
    V.replay(spark.createDataFrame([(1, 1, text), (1, 3, "x = 3;"), (2, 1, None), (None, 1, "n = 1;")], SCHEMA), folder, language)
    out = V.replay(spark.createDataFrame([(1, 2, text.replace("v50 ", "w ")), (2, 2, "y = 1;"), (1, 2, "late = 0;"), (1, 1, "had = 0;"), (1, None, "none = 0;"), (1, 9, "held = 0;")], SCHEMA).coalesce(1), folder, language)
    rows = sorted(((r.doc_id or 0, r.version, r.text, r.parsed_chars) for r in out.collect()), key=lambda r: r[:2])
    assert [(d, v) for d, v, _, _ in rows] == [(0, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert rows[2][2] == text.replace("v50 ", "w ") and rows[2][3] < 60 and rows[4][2:] == (None, 0)
    nodes = V.version_nodes(out)
    assert nodes.where("doc_id = 2 and version = 1").isEmpty() and nodes.where("doc_id = 2 and version = 2").count() > 3


def test_gaps_are_given_up_after_a_while(spark, tmp_path):
    """Version 2 never comes; a later trigger of the running stream takes version 3."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", V.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, "a = 1;"), (1, 3, "a = 3;"), (1, 4, "a = 4;")], SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    arriving = own.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    stream = V.reparsed(arriving, language_for("expr"), patience=500).writeStream.format("memory").queryName("gaps").option("checkpointLocation", f"{folder}/state").start()
    try:
        for _ in range(60):
            stream.awaitTermination(1)
            got = sorted(r.version for r in own.table("gaps").collect())
            if got == [1, 3, 4]:
                break
        assert got == [1, 3, 4]
    finally:
        stream.stop()


def test_names_that_clash_are_refused(spark):
    versions = spark.createDataFrame([], "kind long, version long, text string, tree array<string>, parsed_chars long")
    with pytest.raises(ValueError, match="kind"):
        V.version_nodes(versions)


def test_bytes_in_another_encoding(spark):
    language = language_for("expr")
    old = language.parse("é = 1; b = 2;".encode("latin-1"), "latin-1")
    new = language.reparse(old, "é = 1; ü = 2;".encode("latin-1"), "latin-1")
    assert shape(new) == shape(language.parse("é = 1; ü = 2;"))
    docs = spark.createDataFrame([(1, '{"name": "é"}'.encode("latin-1")), (2, None)], "doc_id long, text binary")
    model = language_for("json").extractor(Named)
    assert [(r.doc_id, r.name) for r in model.extract(docs, encoding="ISO-8859-1").collect()] == [(1, "é")]


def test_versions_are_put_in_order_before_the_state_is_asked(spark, tmp_path):
    """A trigger's versions in the worst order; those behind a gap are held in groups."""
    rows = [(1, v, f"a = {v};\nb = {v % 3};") for v in range(300, 0, -1) if v != 150]
    folder, language = f"file://{tmp_path}/s", language_for("expr")
    out = V.replay(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, language)
    assert sorted(r.version for r in out.collect()) == [*range(1, 150)]
    out = V.replay(spark.createDataFrame([(1, 150, "c = 1;"), (1, 302, "d = 1;")], SCHEMA).coalesce(1), folder, language)
    assert sorted((r.version, r.text) for r in out.collect()) == sorted([(v, t) for _, v, t in rows] + [(150, "c = 1;")])


class _Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "exists": lambda: bool(self.held), "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "keys": lambda: iter(self.held),
                "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": lambda k: self.held.pop(k, None),
            }[name](*args)

        return call


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update


def test_calls_of_the_state_do_not_grow_with_the_versions_of_a_trigger():
    of = V._Versions(language_for("expr"), 1, 0, 0)
    of.last, of.nodes, of.ahead = _Value(), _Value(), _Map()
    of._wait = lambda *_: None
    rows = [{"version": v, "text": f"a = {v}; b = 2;"} for v in range(1000, 0, -1)]
    odd, even = [r for r in rows if r["version"] % 2], [r for r in rows if r["version"] % 2 == 0]
    assert [r.version for r in of.handleInputRows((1,), iter(even), None)] == [] and of.ahead.calls < 100
    assert [(r.version, r.text) for r in of.handleInputRows((1,), iter(odd), None)] == [(r["version"], r["text"]) for r in reversed(rows)]
    assert of.ahead.calls < 200 and not of.ahead.held


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a = 1;", "b = f(2, x);", "d = (1 + 2) * 3;", "}", "c = ", "# note\n", "e=-1;", "é = 2;"]), max_size=5), max_size=6))
def test_rows_of_frozen_trees_are_those_of_the_trees(parts):
    import pyarrow as pa

    from syntaxframe.parse.frozen import FrozenShapes
    from syntaxframe.parse.rows import Wanted, parse_batches

    parser, texts = language_for("expr").parser(), [" ".join(p) for p in parts] * 3
    trees = [parser.parse(t, keep=True) for t in texts]
    frozen = [[frozen_root(t), *(freeze(f, n) for f, n in t.children)] for t in trees]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(frozen, pa.list_(pa.string()))], names=["d", "text", "tree"])
    tree_of = lambda text, tree: thawed(tree[0], tree[1:], text)
    rows = lambda known: sorted(str(r) for b in parse_batches([batch], tree_of, Wanted(), ["d"], known) for r in b.to_pylist())
    assert rows(FrozenShapes().find) == rows(None)


PARTS = ["a = 1;", "b = f(2, x);", "d = (1 + 2) * 3;", "}", "c = ", "# note\n", "e=-1;", "é = 2;", "a = 1; a = 2;", "k=k;"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=6), min_size=2, max_size=12))
def test_versions_of_remembered_stretches_have_the_trees_of_whole_parses(versions):
    from syntaxframe.parse.frozen import Reparser

    parser, texts = language_for("expr").parser(), [" ".join(p) for p in versions] * 2
    remembers, plain = Reparser(parser), parser.parse(texts[0], keep=True)
    tree = remembers.parse(texts[0])
    for text in texts[1:]:
        tree, plain = remembers.reparse(tree, text), parser.reparse(plain, text)
        again = thawed(frozen_root(tree), [n.frozen for _, n in tree.children], text, frozen_marks(tree))
        assert shape(again) == shape(parser.parse(text)) == shape(plain)
        assert (tree.marks, tree.parsed) == (plain.marks, plain.parsed)


def test_a_stretch_that_comes_again_is_not_parsed_again():
    from syntaxframe.parse.frozen import Reparser

    parser, n = language_for("expr").parser(), []
    remembers, quick = Reparser(parser), parser._quick
    parser._quick = lambda *args: n.append(1) or quick(*args)
    try:
        trees = [remembers.parse(f"v = 1; x{i} = {i}; a = 1; z = {i}; y = 2;") for i in range(10)]
        n.clear()
        for i, tree in enumerate(trees):
            assert remembers.reparse(tree, f"v = 1; x{i} = {i}; a = 7; z = {i}; y = 2;").parsed == 7
    finally:
        del parser._quick
    assert len(n) == 1


class Both(OutputModel):
    __match__ = M("source_file", "assignment")
    left: str
    right: int | None = capture("right")


class Ordered(OutputModel):
    __match__ = M("source_file", ..., "assignment")
    right: str | None
    left: str
    again: str | None = capture("left")
    at: Span = source_meta()


def test_captures_by_shape_are_those_of_the_node_rows(spark):
    from syntaxframe.plans import captured
    from syntaxframe.plans.extract import captured_rows

    language, texts = language_for("expr"), [" ".join(PARTS[i:j]) for i in range(len(PARTS)) for j in range(i, len(PARTS) + 1)] * 3
    parser = language.parser()
    trees = [parser.parse(t, keep=True) for t in texts]
    rows = [(i, t, [frozen_root(n), *(freeze(f, c) for f, c in n.children)]) for i, (t, n) in enumerate(zip(texts, trees))]
    versions = spark.createDataFrame(rows, "doc_id int, text string, tree array<string>").coalesce(2)
    for model in (Assignment, Both, Ordered):
        extractor = language.extractor(model, strict=False)
        assert captured.serves(extractor.checked)
        nodes, rows = V.version_nodes(versions, extractor.wanted()), V.version_captures(versions, extractor)
        for got, want in ((captured_rows(rows, extractor.checked, ["doc_id"]), extractor.from_nodes(nodes)), (V.extract_versions(versions, extractor), extractor.extract_nodes(nodes))):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns and not got.isEmpty()


def test_held_versions_beside_the_tree_or_in_the_map():
    """Long versions go to the map, short ones cost no call of it; either come back in their turn, also with other keys between."""
    for size, calls in ((10, 0), (V.BESIDE, 4)):
        of = V._Versions(language_for("expr"), 1, 0, 0)
        of.last, of.ahead = _Value(), _Map()
        of._wait = lambda *_: None
        text = {v: f"a = {v};" + " " * size for v in (1, 2, 3, V.GROUP * 2)}
        got = lambda *vs: [(r.version, r.text) for r in of.handleInputRows((1,), iter([{"version": v, "text": text[v]} for v in vs]), None)]  # noqa: B023, E731
        assert got(3, V.GROUP * 2) == [] and got(2) == [] and got(1) == [(v, text[v]) for v in (1, 2, 3)]
        assert of.ahead.calls <= calls + 2 and list(of.ahead.held) == ([(2,)] if size > 10 else list(of.ahead.held))
        assert V._Document(of).least_held() == V.GROUP * 2
