"""Innermost nodes over spans, against trying all of them."""

import random

import pytest

from syntaxframe.language import language_for
from syntaxframe.operators.ancestry import covering
from syntaxframe.parse.rows import Wanted


@pytest.mark.parametrize("range_bytes", [1 << 20, 7, 1])
def test_innermost_nodes_against_brute_force(spark, range_bytes):
    rng = random.Random(range_bytes)
    texts = {k: rng.choice(['{"a": [1, {"b": "é"}], "c": [[[]]]}', "[1, [2, [3, [4]]]]", "", '{"k" 1', '"x"']) * rng.choice([1, 1, 2]) for k in range(12)}
    docs = spark.createDataFrame([*texts.items(), (None, "[true]")], "doc_id long, text string")
    nodes = language_for("json").nodes(docs, Wanted(None, frozenset(), children=False))
    rows = nodes.select("doc_id", "node_id", "kind", "start_byte", "end_byte").collect()
    asked = []
    for k in [*texts, None, 99]:
        size = len(texts.get(k, "[true]").encode())
        for n in range(8):
            a = rng.randint(0, size)
            asked.append((k, a, min(size + 3, a + rng.choice([0, 1, 1, 2, 5, 30])), f"s{n}"))
    spans = spark.createDataFrame(asked, "doc_id long, start_byte int, end_byte int, node string").repartition(3)

    def innermost(k, a, b):
        found = [r for r in rows if r.doc_id == k and r.start_byte <= a and b <= r.end_byte and a < r.end_byte]
        return (found[-1].node_id, found[-1].kind) if found else (None, None)

    rows.sort(key=lambda r: r.node_id)
    got = covering(nodes, spans, range_bytes=range_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, a, b, n, *innermost(k, a, b))) for k, a, b, n in asked)


def test_nothing_to_cover(spark):
    nodes = language_for("json").nodes(spark.createDataFrame([(1, "[]")], "doc_id long, text string"), Wanted(None, frozenset(), children=False))
    spans = spark.createDataFrame([], "doc_id long, start_byte int, end_byte int")
    assert covering(nodes, spans).collect() == []
