"""Elements of pages against plain pairing, and ancestors through gaps."""

import pytest

from syntaxframe.language import language_for
from syntaxframe.operators import elements
from syntaxframe.operators.ancestry import inside, outside
from syntaxframe.parse.rows import Wanted


def nodes_of(spark, pages):
    docs = spark.createDataFrame(pages, "doc_id long, text string").repartition(2)
    return language_for("html").nodes(docs, Wanted(elements.KINDS | {"text"}, frozenset(("text",))))


def shown(spark, html):
    """(name, text between start and end, closed) of each element, by its place."""
    raw = html.encode()
    rows = elements.elements(nodes_of(spark, [(1, html)])).collect()
    return [(r.name, raw[r.start_byte : r.end_byte].decode(), r.closed, r.depth) for r in sorted(rows, key=lambda r: r.node_id)]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<div><p>a<p>b</div>c", [("div", "<div><p>a<p>b</div>", True, 0), ("p", "<p>a", False, 1), ("p", "<p>b", False, 1)]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", True, 0), ("li", "<li>a", False, 1), ("li", "<li>b<ul><li>c</ul>", False, 1), ("ul", "<ul><li>c</ul>", True, 2), ("li", "<li>c", False, 3), ("li", "<li>d", False, 1)]),
        ("<p>a<br>é<b>x</p>y</b>", [("p", "<p>a<br>é<b>x</p>", True, 0), ("br", "<br>", True, 1), ("b", "<b>x", False, 1)]),
        ("</div><DIV>a</div></div>", [("div", "<DIV>a</div>", True, 0)]),
        ("<h2>a</h2><title>t</title><a href='x'>l</a>", [("h2", "<h2>a</h2>", True, 0), ("title", "<title>t</title>", True, 0), ("a", "<a href='x'>l</a>", True, 0)]),
        ("<p><script>'</p>'</script>z</p>", [("p", "<p><script>'</p>'</script>z</p>", True, 0), ("script", "<script>'</p>'</script>", True, 1)]),
        ("<nav><a href='1'>x", [("nav", "<nav><a href='1'>x", False, 0), ("a", "<a href='1'>x", False, 1)]),
        ("", []),
        ("plain", []),
    ],
)
def test_pairs(spark, html, expected):
    assert shown(spark, html) == expected


def test_links_below_an_element_through_gaps(spark):
    pages = [(1, "<nav><ul><li><a href='1'>a</a></ul></nav><a href='2'>b</a>"), (2, "<a href='3'>c</a><nav><div><nav><a href='4'>d</a></nav></div><a href='5'>e</a>"), (3, None), (4, "<p>none</p>")]
    nodes = nodes_of(spark, pages)
    links = nodes.where("kind = 'link'")
    navs = elements.elements(nodes).where("name = 'nav'")
    at = lambda df: sorted((r.doc_id, r.start_byte) for r in df.collect())
    places = [(i, html.index(f"<a href='{k}'")) for k, (i, html) in zip("12345", [pages[0]] * 2 + [pages[1]] * 3)]
    assert at(inside(links, navs)) == sorted([places[0], places[3], places[4]])
    assert at(outside(links, navs)) == sorted([places[1], places[2]])


def test_deep_pages_take_one_pass(spark):
    html = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = elements.elements(nodes_of(spark, [(1, html)])).collect()
    assert len(rows) == 3000 and all(r.closed for r in rows) and max(r.depth for r in rows) == 2999


def test_documents_are_told_apart_by_integers_or_strings(spark):
    html = language_for("html")
    docs = spark.createDataFrame([("a", "<p>x"), ("b", "<p>y</p>"), (None, "<p>z")], "doc_id string, text string")
    rows = elements.elements(html.nodes(docs, Wanted(elements.KINDS, frozenset()))).collect()
    assert sorted((str(r.doc_id), r.closed) for r in rows) == [("None", False), ("a", False), ("b", True)]
    with pytest.raises(TypeError, match="double"):
        elements.elements(html.nodes(docs.withColumn("doc_id", docs.doc_id.cast("double")), Wanted(elements.KINDS, frozenset())))
