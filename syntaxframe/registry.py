"""The registered queries: each shows one operator over whole tables, with the SQL that gives the same rows.

Where no SQL parses text, the text is made from relational rows first, so the SQL is over those rows (a round trip).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Annotated

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import coerce
from .grammar.dsl import Grammar, alias, choice, field, pattern, ref, repeat, seq, token
from .language import language_for
from .model import AnyOf, Eq, M, Matches, NodeKind, OutputModel, RawQuery, Unescaped, capture, capture_kind, derived, source_meta
from .operators import ancestry, elements, reparse
from .parse.rows import Wanted
from .sources.docs import from_table, nested
from .sources.staging import shared_dir, staged
from .valuemap import ValueMap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_table(spark, sf_dir, "events"), "event_id", "props")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_table(spark, sf_dir, "pages"), "page_id", "html")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# JSON records.


class KeyK(OutputModel):
    __match__ = M("document", "object", record=True)
    k: int


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_record_scalar(spark, sf_dir):
    return KeyK.extract(_events(spark, sf_dir), language="json").select("doc_id", "k")


class KeyDefault(KeyK):
    z: int = 7


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(7 AS BIGINT) AS z FROM events")
def json_record_default(spark, sf_dir):
    return KeyDefault.extract(_events(spark, sf_dir), language="json").select("doc_id", "k", "z")


class KeyOptional(KeyK):
    z: str | None


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS z FROM events")
def json_record_optional(spark, sf_dir):
    return KeyOptional.extract(_events(spark, sf_dir), language="json").select("doc_id", "k", "z")


class KeyEq(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[int, Eq("12")]


@query("SELECT event_id AS doc_id, CAST(12 AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 12")
def json_record_predicate_req(spark, sf_dir):
    return KeyEq.extract(_events(spark, sf_dir), language="json").select("doc_id", "k")


class KeyEqOptional(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[int | None, Eq("12")]


@query("SELECT event_id AS doc_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 12 THEN CAST(12 AS BIGINT) END AS k FROM events")
def json_record_predicate_opt(spark, sf_dir):
    return KeyEqOptional.extract(_events(spark, sf_dir), language="json").select("doc_id", "k")


class KeyAny(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[int, AnyOf("3", "33", "93")]


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (3, 33, 93)")
def json_record_anyof(spark, sf_dir):
    return KeyAny.extract(_events(spark, sf_dir), language="json").select("doc_id", "k")


class KeyMatches(OutputModel):
    __match__ = M("document", "object", record=True)
    k: Annotated[int, Matches(r"^9\d$")]


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^9[0-9]$')")
def json_record_matches(spark, sf_dir):
    return KeyMatches.extract(_events(spark, sf_dir), language="json").select("doc_id", "k")


class RegionKeys(OutputModel):
    __match__ = M("document", "object", record=True)
    keys: list[int]


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS keys, COUNT(*) AS n FROM nation GROUP BY 1")
def json_list(spark, sf_dir):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: k.cast("string")), ", ")
    docs = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(_text('{"keys": [', keys, "]}").alias("text"))
    rows = RegionKeys.extract(docs, language="json")
    return rows.select("doc_id", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"), F.size("keys").cast("long").alias("n"))


class RegionPart(OutputModel):
    __match__ = M("document", ..., "object", record=True)
    key: int
    name: str


class NationNested(OutputModel):
    __match__ = M("document", "object", record=True)
    name: str
    region: RegionPart


def _nation_docs(spark, sf_dir, *parts) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), _text(*parts).alias("text"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name, CAST(r_regionkey AS BIGINT) AS region_key, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_nested(spark, sf_dir):
    docs = _nation_docs(spark, sf_dir, '{"region": {"name": "', F.col("r_name"), '", "key": ', F.col("r_regionkey"), '}, "name": "', F.col("n_name"), '"}')
    rows = NationNested.extract(docs, language="json")
    return rows.select("doc_id", "name", F.col("region.key").alias("region_key"), F.col("region.name").alias("region_name"))


class NameOnly(OutputModel):
    __match__ = M("document", "object", record=True)
    name: str


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name FROM nation")
def json_scope(spark, sf_dir):
    docs = _nation_docs(spark, sf_dir, '{"inner": {"name": "', F.col("r_name"), '"}, "name": "', F.col("n_name"), '"}')
    return NameOnly.extract(docs, language="json").select("doc_id", "name")


class AnyName(OutputModel):
    __match__ = M("document", ..., "object", record=True)
    name: str


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_gap_records(spark, sf_dir):
    docs = _nation_docs(spark, sf_dir, '{"name": "', F.col("n_name"), '", "in": [[{"name": "', F.col("r_name"), '"}]]}')
    return AnyName.extract(docs, language="json").select("doc_id", "name")


class Escaped(OutputModel):
    __match__ = M("document", "object", record=True)
    s: Annotated[str, Unescaped()]


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || chr(10) || '"q"' || chr(9) || 'é' || '/' AS s FROM nation""")
def json_unescape(spark, sf_dir):
    docs = _nation_docs(spark, sf_dir, '{"s": "', F.col("n_name"), '\\n\\"q\\"\\t\\u00e9\\/"}')
    return Escaped.extract(docs, language="json").select("doc_id", "s")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || chr(92) || 'q' || chr(9) AS s FROM nation""")
def json_unescape_fallback(spark, sf_dir):
    docs = _nation_docs(spark, sf_dir, '{"s": "', F.col("n_name"), '\\q\\t"}')
    return Escaped.extract(docs, language="json").select("doc_id", "s")


def _customers(spark, sf_dir) -> DataFrame:
    again = F.when(F.col("c_custkey") % 3 == 0, F.lit(', "name": "twice"')).otherwise("")
    text = _text('{"name": "', F.col("c_name"), '"', again, "}")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query("SELECT c_custkey AS doc_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def json_ambiguous_lenient(spark, sf_dir):
    return NameOnly.extract(_customers(spark, sf_dir), language="json", strict=False).select("doc_id", "name")


@query("SELECT c_custkey AS doc_id, 'name: ambiguous, several nodes were captured' AS error FROM customer WHERE c_custkey % 3 = 0")
def json_ambiguous_failures(spark, sf_dir):
    failed = language_for("json").extractor(NameOnly, strict=False).failures(_customers(spark, sf_dir))
    return failed.select("doc_id", F.array_join("errors", "; ").alias("error"))


@query("SELECT COUNT(*) AS failures FROM supplier WHERE s_suppkey % 4 = 0")
def strict_failure_count(spark, sf_dir):
    value = F.when(F.col("s_suppkey") % 4 == 0, F.lit("1.5")).otherwise(F.col("s_suppkey").cast("string"))
    docs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), _text('{"k": ', value, "}").alias("text"))
    return language_for("json").extractor(KeyK).failures(docs).agg(F.count("*").alias("failures"))


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 5 = 0")
def parse_problems(spark, sf_dir):
    """Texts that lack their last brace have a missing node; all others have none."""
    end = F.when(F.col("c_custkey") % 5 == 0, "").otherwise("}")
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _text('{"name": "', F.col("c_name"), '"', end).alias("text"))
    nodes = language_for("json").nodes(docs, Wanted(None, frozenset(), children=False))
    return ancestry.problems(nodes).select("doc_id").distinct()


@query("SELECT k AS kind, (SELECT COUNT(*) FROM events) AS n FROM (VALUES ('document'), ('object'), ('pair'), ('string'), ('string_content'), ('number')) x(k)")
def kind_scan(spark, sf_dir):
    nodes = language_for("json").nodes(_events(spark, sf_dir), Wanted(None, frozenset(), children=False))
    return nodes.where("named").groupBy("kind").agg(F.count("*").alias("n"))


# Conversions.


def _of_events(spark, sf_dir, text: Column, f) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), f(text).alias("v"))


@query("SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN -k WHEN 2 THEN k END AS v FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def coerce_int(spark, sf_dir):
    """Whole numbers, with a sign, with an empty fraction, and texts that are none."""
    k, turn = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    text = F.when(turn == 0, F.concat(F.lit(" "), k)).when(turn == 1, F.concat(F.lit("-"), k)).when(turn == 2, F.concat(k, F.lit(".0"))).otherwise(F.concat(F.lit("0x"), k))
    return _of_events(spark, sf_dir, text, coerce.to_int)


@query("SELECT event_id AS doc_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN floor(value) * 100 END AS v FROM events")
def coerce_float(spark, sf_dir):
    """Numbers with a fraction, with an exponent, and texts that are none."""
    whole, turn = F.floor("value").cast("string"), F.col("event_id") % 3
    text = F.when(turn == 0, F.col("value").cast("string")).when(turn == 1, F.concat(whole, F.lit("e2"))).otherwise(F.concat(F.lit("v"), whole))
    return _of_events(spark, sf_dir, text, coerce.to_float)


@query("SELECT event_id AS doc_id, CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN TRUE WHEN 'error' THEN FALSE END AS v FROM events")
def coerce_bool(spark, sf_dir):
    """Words for yes and no, and others."""
    kind = F.col("event_type")
    return _of_events(spark, sf_dir, F.when(kind == "click", "Yes").when(kind == "view", "on").when(kind == "error", "off").otherwise(kind), coerce.to_bool)


# INI.

INI_VALUES = ValueMap({"integer": "int", "boolean": "bool", "bare": "str"}, {"string": "string_content"})


def _ini():
    return language_for("ini").with_schema(language_for("ini").schema, INI_VALUES)


class SupplierSection(OutputModel):
    __match__ = M("source_file", "section", record=True)
    key: int
    name: str
    local: bool = False
    line: int = source_meta()


def _ini_docs(spark, sf_dir) -> DataFrame:
    """One text for each nation, a section for each of its suppliers."""
    one = _text("[s", F.col("s_suppkey"), ']\nname = "', F.col("s_name"), '"\n; a note\nkey = ', F.col("s_suppkey"), "\nlocal = true\nnick: n", F.col("s_suppkey"), "\n")
    texts = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("doc_id"))
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("t")))), lambda s: s["t"]), "").alias("text"))


@query("SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey AS key, s_name AS name, TRUE AS local, 6 * (ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) + 1 AS line FROM supplier")
def ini_sections(spark, sf_dir):
    docs = _ini_docs(spark, sf_dir)
    return _ini().extractor(_pinned(SupplierSection, "entry")).extract(docs).select("doc_id", "key", "name", "local", "line")


class Nick(OutputModel):
    __match__ = M("source_file", "section", record=True, record_pair="note")
    nick: str


def _pinned(model, pair):
    return type(model.__name__, (model,), {"__match__": M(*model.__dict__["__match__"].steps, record=True, record_pair=pair)})


@query("SELECT CAST(s_nationkey AS BIGINT) AS doc_id, 'n' || s_suppkey AS nick FROM supplier")
def ini_record_pair(spark, sf_dir):
    return _ini().extractor(Nick).extract(_ini_docs(spark, sf_dir)).select("doc_id", "nick")


class Directive(OutputModel):
    __match__ = M("source_file", "directive")
    name: str
    value: int


@query("SELECT p_partkey AS doc_id, 'size' AS name, CAST(p_size AS BIGINT) AS value FROM part")
def ini_directive_kind_inferred(spark, sf_dir):
    text = _text('@brand "', F.col("p_brand"), '"\n@size ', F.col("p_size"), "\n@new true\n")
    docs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return _ini().extractor(Directive).extract(docs).select("doc_id", "name", "value")


class Section(OutputModel):
    __match__ = M("source_file", "section")
    name: str


class JsonInIni(OutputModel):
    __match__ = M("document", "object", record=True)
    nation: int


@query("SELECT s_suppkey AS doc_id, CAST(1 AS INTEGER) AS outer_row, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def nested_parse(spark, sf_dir):
    text = _text("[a]\nmeta = {\"nation\": ", F.col("s_nationkey"), "}\n")
    docs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    inner = nested(language_for("ini").nodes(docs, Wanted(frozenset(("bare",)), frozenset(("bare",)), children=False)), "bare")
    return JsonInIni.extract(inner, language="json").select("doc_id", "outer_row", "nation")


# HTML.

HTML_VALUES = ValueMap({"bare_value": "str"}, {"quoted_value": "value_content"})


def _html():
    return language_for("html").with_schema(language_for("html").schema, HTML_VALUES)


class LinkTarget(OutputModel):
    __match__ = M("document", "link", record=True)
    href: str


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return _html().extractor(LinkTarget).extract(_pages(spark, sf_dir)).select("doc_id", "href")


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<&]*)', 1)) AS label FROM pages")
def html_attr_records(spark, sf_dir):
    """The attributes as a record and the label as a field of the same node, over one parse."""
    both = [_html().extractor(LinkTarget), _html().extractor(LinkLabel)]
    nodes = _html().shared_nodes(_pages(spark, sf_dir), both)
    return both[0].extract_nodes(nodes).join(both[1].extract_nodes(nodes), ["doc_id", "node_id"]).select("doc_id", "href", "label")


class LinkLabel(OutputModel):
    __match__ = M("document", "link")
    label: str = capture("content")


class Title(OutputModel):
    __match__ = M("document", "title")
    title: str = capture("content")


@query("SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS title FROM pages WHERE regexp_matches(html, '<title>[^<]+</title>')")
def html_titles(spark, sf_dir):
    return Title.extract(_pages(spark, sf_dir), language="html").select("doc_id", "title")


class Heading(OutputModel):
    __match__ = M("document", "heading")
    level: str
    text: str = capture("content")


@query("SELECT page_id AS doc_id, '<h1' AS level, unnest(regexp_extract_all(html, '<h1>([^<]+)', 1)) AS text FROM pages UNION ALL SELECT page_id, '<h2', unnest(regexp_extract_all(html, '<h2>([^<]+)', 1)) FROM pages UNION ALL SELECT page_id, '<h3', unnest(regexp_extract_all(html, '<h3>([^<]+)', 1)) FROM pages")
def html_headings(spark, sf_dir):
    return Heading.extract(_pages(spark, sf_dir), language="html").select("doc_id", "level", "text")


class Script(OutputModel):
    __match__ = M("document", "script")
    body: str


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1)) AS body FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1)) FROM pages")
def html_script_opaque(spark, sf_dir):
    return Script.extract(_pages(spark, sf_dir), language="html").select("doc_id", "body")


class EndTag(OutputModel):
    __match__ = M("document", "element_end")
    name: Annotated[str, Eq("html")]


@query("SELECT page_id AS doc_id FROM pages WHERE html NOT LIKE '%</html>%'")
def html_unclosed(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    closed = EndTag.extract(pages, language="html").select("doc_id")
    return pages.join(closed, "doc_id", "left_anti").select("doc_id")


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def html_links_of_files(spark, sf_dir):
    """The links of pages that lie in a folder as files, read by the data source of documents."""
    import uuid

    from .sources import documents

    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    # Files of fifty pages, a line each.
    _table(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", "html")).alias("value")).write.option("maxRecordsPerFile", 50).text(folder)
    documents.register(spark)
    files = spark.read.format("documents").load(folder).where("kind = 'txt'")
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    each = lines.select(F.get_json_object("line", "$.page_id").cast("long").alias("doc_id"), F.get_json_object("line", "$.html").alias("text"))
    return _html().extractor(LinkTarget).extract(each).select("doc_id", "href")


@query("WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<nav>(.*?)</nav>', 1)) AS inner_html FROM pages) SELECT page_id AS doc_id, unnest(regexp_extract_all(inner_html, '<a href=\"([^\"]*)\">', 1)) AS href FROM n")
def html_ancestor_gap(spark, sf_dir):
    """Links anywhere below a nav element: tags are paired to elements, whose intervals the links must lie in."""
    links = _html().extractor(LinkTarget)
    want = replace(links.wanted(), kinds=links.wanted().kinds | elements.KINDS, children=True)
    nodes = staged(_html().nodes(_pages(spark, sf_dir), want), "nodes")
    return links.scoped(nodes, elements.elements(nodes).where("name = 'nav'")).select("doc_id", "href")


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<p>')) AS n, len(regexp_extract_all(html, '<(?:br|meta)[ >]')) AS n_void FROM pages")
def html_elements(spark, sf_dir):
    """Paragraphs and void elements of pages; paragraphs often lack their end tags."""
    nodes = _html().nodes(_pages(spark, sf_dir), Wanted(elements.KINDS, frozenset()))
    found = elements.elements(nodes).groupBy("doc_id").agg(F.count_if(F.col("name") == "p").alias("n"), F.count_if(F.col("name").isin("br", "meta")).alias("n_void"))
    return _pages(spark, sf_dir).select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("n_void", F.lit(0)).cast("long").alias("n_void"))


# Lines, tokens and places.


class Line(OutputModel):
    __match__ = M("document", "line")
    content: str
    line: int = source_meta()


@query("SELECT doc_id, unnest([x FOR x IN string_split(text, chr(10)) IF x <> '']) AS content FROM documents")
def doc_lines(spark, sf_dir):
    return Line.extract(_documents(spark, sf_dir), language="lines").select("doc_id", "content")


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS line, length(parts[i]) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s) WHERE parts[i] <> ''")
def doc_line_numbers(spark, sf_dir):
    rows = Line.extract(_documents(spark, sf_dir), language="lines")
    return rows.select("doc_id", "line", F.length("content").cast("long").alias("n"))


@query("WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), t AS (SELECT doc_id, text, parts, list_max([i FOR i IN range(1, len(parts) + 1) IF parts[i] <> '']) AS i FROM s) SELECT doc_id, CAST(i AS BIGINT) AS last_line, CAST(strlen(array_to_string(parts[1:i-1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS BIGINT) AS start_byte FROM t WHERE i IS NOT NULL")
def doc_span_bytes(spark, sf_dir):
    nodes = language_for("lines").nodes(_documents(spark, sf_dir), Wanted(frozenset(("line",)), frozenset(), children=False))
    last = nodes.groupBy("doc_id").agg(F.max(F.struct("node_id", "start_row", "start_byte")).alias("n"))
    return last.select("doc_id", (F.col("n.start_row") + 1).cast("long").alias("last_line"), F.col("n.start_byte").cast("long").alias("start_byte"))


@query("SELECT 'email' AS kind, CAST(SUM(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'))) AS BIGINT) AS n FROM documents")
def doc_tokens_by_kind(spark, sf_dir):
    nodes = language_for("tokens").nodes(_documents(spark, sf_dir), Wanted(frozenset(("email",)), frozenset(), children=False, places=False))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(strlen(head) AS BIGINT) AS start_byte, 'content' AS kind, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, left(text, CAST(strpos(text, '@') - 1 AS INTEGER)) AS head FROM documents WHERE contains(text, '@'))")
def covering_nodes(spark, sf_dir):
    """The innermost node at the first @ of each text, and its line."""
    docs = _documents(spark, sf_dir)
    at = F.octet_length(F.substring_index("text", "@", 1))
    spans = docs.where(F.contains("text", F.lit("@"))).select("doc_id", at.alias("start_byte"), (at + 1).alias("end_byte"))
    nodes = staged(language_for("lines").nodes(docs, Wanted(frozenset(("line", "content")), frozenset(), children=False)).select("doc_id", "node_id", "kind", "start_byte", "end_byte", "start_row"), "nodes")
    found = ancestry.covering(nodes, spans).join(nodes.select("doc_id", "node_id", "start_row"), ["doc_id", "node_id"])
    return found.select("doc_id", F.col("start_byte").cast("long").alias("start_byte"), "kind", (F.col("start_row") + 1).cast("long").alias("line"))


# Expressions.

SHAPES = (
    ("1 + 2 * 3;", "((number) + ((number) * (number)))"),
    ("1 - 2 - 3;", "(((number) - (number)) - (number))"),
    ("2 ^ 3 ^ 4;", "((number) ^ ((number) ^ (number)))"),
    ("-a * b;", "((- (identifier)) * (identifier))"),
    ("a < b and not c;", "(((identifier) < (identifier)) and (not (identifier)))"),
    ("(1 + 2) * 3;", "((( ((number) + (number)) )) * (number))"),
    ("f(x, 1)(y);", "(((identifier) ( (identifier) , (number) )) ( (identifier) ))"),
)


class SumOfProduct(OutputModel):
    __raw_query__ = RawQuery("(binary left: (number) @q right: (binary left: (number) @p right: (number) @d))")
    q: float
    p: float
    d: float


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity + l_extendedprice * l_discount AS v FROM lineitem")
def expr_eval(spark, sf_dir):
    text = _text(F.col("l_quantity"), " + ", F.col("l_extendedprice"), " * ", F.col("l_discount"), ";")
    docs = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), text.alias("text"))
    rows = language_for("expr").extractor(SumOfProduct).extract(docs)
    return rows.select("l_orderkey", "l_linenumber", (F.col("q") + F.col("p") * F.col("d")).alias("v"))


class Assign(OutputModel):
    __raw_query__ = RawQuery('(assignment left: (identifier) @name right: (number) @value (#match? @name "^N"))')
    name: str
    value: int


def _assignments(spark, sf_dir) -> DataFrame:
    text = _text(F.col("n_name"), " = ", F.col("n_nationkey"), "; r = ", F.col("n_regionkey"), "; s = a + 1;")
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name, CAST(n_nationkey AS BIGINT) AS value FROM nation")
def raw_query(spark, sf_dir):
    return Assign.extract(_assignments(spark, sf_dir), language="expr").select("doc_id", "name", "value")


class Either(OutputModel):
    __raw_query__ = RawQuery("(assignment left: (identifier) @name right: (number)) (binary left: (identifier) @name)")
    name: str
    line: int = source_meta()


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name, CAST(1 AS BIGINT) AS line FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'r', 1 FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'a', 1 FROM nation")
def raw_multi_pattern(spark, sf_dir):
    return Either.extract(_assignments(spark, sf_dir), language="expr").select("doc_id", "name", "line")


class Pinned(OutputModel):
    __match__ = M("source_file", "assignment")
    name: str = capture("left")
    origin: str = derived("nation")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS name, 'nation' AS origin FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'r', 'nation' FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 's', 'nation' FROM nation")
def derived_const(spark, sf_dir):
    return Pinned.extract(_assignments(spark, sf_dir), language="expr").select("doc_id", "name", "origin")


class Ordered(OutputModel):
    __match__ = M("source_file", "expression_statement", "call")
    function: str
    first: str = capture("argument")
    second: str = capture("argument")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'f' AS function, n_name AS first, CAST(n_regionkey AS VARCHAR) AS second FROM nation")
def ordered_captures(spark, sf_dir):
    text = _text("f(", F.col("n_name"), ", ", F.col("n_regionkey"), ");")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return Ordered.extract(docs, language="expr").select("doc_id", "function", "first", "second")


class AnyCall(OutputModel):
    __match__ = M("source_file", ..., "call")
    function: str
    line: int = source_meta()


class LeftSide(OutputModel):
    __match__ = M("source_file", "assignment")
    name: str = capture("left")
    line: int = source_meta()


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(2 AS BIGINT) AS line, n_name AS name, 'g' AS function FROM nation")
def models_paired_by_line(spark, sf_dir):
    """Two models over one parse, their rows paired by line."""
    text = _text("f(1);\n", F.col("n_name"), " = g(2);\nz = 3;")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    both = [language_for("expr").extractor(LeftSide), language_for("expr").extractor(AnyCall)]
    nodes = language_for("expr").shared_nodes(docs, both)
    left, right = (e.extract_nodes(nodes).drop("node_id") for e in both)
    return left.join(right, ["doc_id", "line"]).select("doc_id", "line", "name", "function")


class Arguments(OutputModel):
    __match__ = M("source_file", ..., "call")
    arguments: list[str] = capture("argument")
    line: int = source_meta()


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '|' || n_regionkey AS arguments, CAST(2 AS BIGINT) AS line FROM nation")
def field_list(spark, sf_dir):
    text = _text("a = 1;\nb = -f(", F.col("n_name"), ", ", F.col("n_regionkey"), ");")
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return Arguments.extract(docs, language="expr").select("doc_id", F.array_join("arguments", "|").alias("arguments"), "line")


# Block configuration.


CONF_VALUES = ValueMap({"integer": "int", "boolean": "bool"}, {"string": "string_content"}, {"list": ["string", "integer", "boolean"]})


class ConfPair(OutputModel):
    __match__ = M("source_file", ..., "block", "binding")
    path: str
    value: Annotated[str, NodeKind("string")]


def _conf_docs(spark, sf_dir) -> DataFrame:
    """One text for each region: region.<name> = { nations = { <name> = "<key>"; ... }; size = <n>; };"""
    one = _text(F.col("n_name"), ' = "', F.col("n_nationkey"), '"; ')
    nations = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("t")))), lambda s: s["t"]), "")
    text = _text("# regions\nregion.R", F.col("r_regionkey"), " = { nations = { ", nations, "}; size = ", F.count("*"), "; };")
    joined = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_regionkey").agg(text.alias("text")).select(F.col("r_regionkey").cast("long").alias("doc_id"), "text")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS path, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def conf_pairs(spark, sf_dir):
    conf = language_for("conf").with_schema(language_for("conf").schema, CONF_VALUES)
    return conf.extractor(ConfPair).extract(_conf_docs(spark, sf_dir)).select("doc_id", "path", "value")


def _bindings(spark, sf_dir) -> DataFrame:
    nodes = language_for("conf").nodes(_conf_docs(spark, sf_dir), Wanted(frozenset(("binding",)), frozenset()))
    return staged(_of_bindings(nodes), "bindings")


def _of_bindings(nodes: DataFrame) -> DataFrame:
    path = F.try_element_at(F.filter("children", lambda c: c["field"] == "path"), F.lit(1))["text"]
    value = F.try_element_at(F.filter("children", lambda c: c["field"] == "value"), F.lit(1))
    return nodes.select("doc_id", "node_id", "last_id", "start_byte", "end_byte", path.alias("key"), value["kind"].alias("value_kind"), value["start_byte"].alias("from_byte"), value["end_byte"].alias("to_byte"))


_DOTTED = "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'region.R' || n_regionkey || '.nations.' || n_name AS dotted FROM nation"


@query(_DOTTED + " UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'region.R' || r_regionkey FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'region.R' || r_regionkey || '.nations' FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'region.R' || r_regionkey || '.size' FROM region")
def dotted_path(spark, sf_dir):
    nodes = language_for("conf").nodes(_conf_docs(spark, sf_dir), Wanted(frozenset(("binding",)), frozenset()))
    return ancestry.dotted_paths(_of_bindings(nodes), "key").select("doc_id", "dotted")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS key FROM nation")
def ancestor_semi(spark, sf_dir):
    rows = _bindings(spark, sf_dir)
    return ancestry.inside(rows, rows.where("key = 'nations'")).select("doc_id", "key")


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, k AS key FROM region, (VALUES ('size'), ('nations'), (NULL)) x(k) WHERE k IS NOT NULL UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'region.R' || r_regionkey FROM region")
def ancestor_anti(spark, sf_dir):
    rows = _bindings(spark, sf_dir)
    return ancestry.outside(rows, rows.where("key = 'nations'")).select("doc_id", "key")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS key, 'string' AS kind FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'size', 'integer' FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'nations', 'block' FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'region.R' || r_regionkey, 'block' FROM region")
def span_lookup(spark, sf_dir):
    """The node at the bytes of each binding's value."""
    nodes = staged(language_for("conf").nodes(_conf_docs(spark, sf_dir), Wanted(None, frozenset())), "nodes")
    spans = _of_bindings(nodes.where("kind = 'binding'")).select("doc_id", F.col("from_byte").alias("start_byte"), F.col("to_byte").alias("end_byte"), "key")
    return ancestry.at_span(nodes, spans).select("doc_id", "key", "kind")


@query("SELECT c.category AS category, CAST(c.n AS BIGINT) AS n FROM (SELECT 'nation' AS category, COUNT(*) AS n FROM nation UNION ALL SELECT 'count', COUNT(*) FROM region UNION ALL SELECT 'other', 2 * COUNT(*) FROM region) c")
def classify(spark, sf_dir):
    nodes = language_for("conf").nodes(_conf_docs(spark, sf_dir), Wanted(frozenset(("binding",)), frozenset()))
    dotted = ancestry.dotted_paths(_of_bindings(nodes), "key")
    category = F.when(F.col("dotted").rlike(r"\.nations\."), "nation").when(F.col("dotted").endswith(".size"), "count").otherwise("other")
    return dotted.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


class FirstName(OutputModel):
    __match__ = M("source_file", "binding", "path")
    names: list[str] = capture_kind("identifier")


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'region/R' || r_regionkey AS names FROM region")
def child_kind_capture(spark, sf_dir):
    return FirstName.extract(_conf_docs(spark, sf_dir), language="conf").select("doc_id", F.array_join("names", "/").alias("names"))


class Flag(OutputModel):
    __match__ = M("document", "array", ("true", "false"))
    line: int = source_meta()


@query("SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS line FROM orders WHERE o_orderstatus <> 'P'")
def alternation_anchor(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("null")
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _text("[", flag, "]").alias("text"))
    return Flag.extract(docs, language="json").select("doc_id", "line")


class KindTuple(OutputModel):
    __match__ = M("document", "object", "pair")
    value: Annotated[bool, NodeKind("true", "false")]


@query("SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS value FROM orders WHERE o_orderstatus <> 'P'")
def nodekind_tuple(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("null")
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _text('{"v": ', flag, "}").alias("text"))
    return KindTuple.extract(docs, language="json").select("doc_id", "value")


@query("SELECT kind, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT 'title' AS kind, COUNT(*) AS n FROM pages WHERE regexp_matches(html, '<title>[^<]+</title>') UNION ALL SELECT 'link', CAST(SUM(len(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<&]+'))) AS BIGINT) FROM pages) GROUP BY 1")
def multi_model_shared_parse(spark, sf_dir):
    html = language_for("html")
    both = [html.extractor(Title), html.extractor(LinkLabel)]
    nodes = html.shared_nodes(_pages(spark, sf_dir), both)
    rows = [e.extract_nodes(nodes).groupBy(F.lit(k).alias("kind")).agg(F.count("*").alias("n")) for k, e in zip(("title", "link"), both)]
    return rows[0].unionByName(rows[1])


# Versions, schemas, grammars.


@query("SELECT doc_id, CAST(length(text) // 2 AS BIGINT) AS start, CAST(length(text) // 2 AS BIGINT) AS old_end, CAST(length(text) // 2 + 3 AS BIGINT) AS new_end FROM documents WHERE length(text) >= 2")
def reparse_diff(spark, sf_dir):
    """Three characters that no text has are put into the middle of each."""
    docs = _documents(spark, sf_dir).where("length(text) >= 2")
    half = (F.length("text") / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), half), F.lit("☃☃☃"), F.substr("text", half + 1))
    rows = reparse.with_edit(docs.withColumn("new", new), "text", "new")
    return rows.select("doc_id", *(F.col(k).cast("long").alias(k) for k in ("start", "old_end", "new_end")))


def broken_grammar() -> Grammar:
    g = Grammar("broken")
    g.rule("source_file", seq(ref("missing"), repeat(choice("a", pattern("b*"))), ref("empty")))
    g.rule("empty", pattern("x*"))
    g.rule("unused", token(seq("q", ref("empty"))))
    g.rule("flagged", pattern("z", "ig"))
    g.rule("named", choice(alias(choice("u", "v"), "w"), field("f", "t")))
    return g


@query("SELECT * FROM (SELECT event_id AS doc_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'number' AS kind FROM events)")
def sql_table_function(spark, sf_dir):
    from .functions import udtf

    udtf.register(spark)
    _events(spark, sf_dir).createOrReplaceTempView("event_texts")
    return spark.sql("SELECT doc_id, key, value, kind FROM event_texts, LATERAL extract_json_records(text)")


SHELL = "#!/bin/sh\nNAME=one\ngreet() {\n  cat <<EOF > out\nhi {k}\nEOF\n}\ngreet a 'b c'\nX=\"y\"\n"


class Assignment(OutputModel):
    __match__ = M("program", "variable_assignment")
    name: str
    line: int = source_meta()


class Heredoc(OutputModel):
    __match__ = M("program", ..., "heredoc")
    start: str
    body: str
    line: int = source_meta()


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'EOF' AS start, 'hi ' || r_name || chr(10) || 'EOF' AS body, CAST(4 AS BIGINT) AS line FROM region")
def shell_heredocs(spark, sf_dir):
    docs = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.replace(F.lit(SHELL), F.lit("{k}"), F.col("r_name")).alias("text"))
    return Heredoc.extract(docs, language="shell").select("doc_id", "start", "body", "line")


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, n AS name, CAST(l AS BIGINT) AS line FROM region, (VALUES ('NAME=', 2), ('X=', 9)) x(n, l)")
def shell_assignments(spark, sf_dir):
    docs = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(SHELL).alias("text"))
    return Assignment.extract(docs, language="shell").select("doc_id", "name", "line")


@query("SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def stream_extract(spark, sf_dir):
    """The events table replayed as a stream of files; the rows are those of the batch query."""
    import uuid

    from .streaming.incremental import extract_stream, replayed

    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _table(spark, sf_dir, "events")
    stream = from_table(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), "event_id", "props")
    replayed(lambda docs: extract_stream(docs, language_for("json").extractor(KeyK)), stream, f"{work}/rows", f"{work}/state")
    return spark.read.parquet(f"{work}/rows").select("doc_id", "k")


@query("SELECT 'all' AS rows_of, count(*) AS n, CAST(sum(CASE WHEN s_suppkey % 9 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS failed, min(CASE WHEN s_suppkey % 9 = 4 THEN s_suppkey END) AS first_failed FROM supplier UNION ALL SELECT 'good', count(*), 0, NULL FROM supplier WHERE s_suppkey % 9 <> 4")
def strict_over_tables(spark, sf_dir):
    """Strict extraction of a whole table: one error with the number of failed rows and the first of them; and of the rows that are good."""
    from .errors import ExtractionError

    key = F.col("s_suppkey")
    value = F.when(key % 9 == 4, F.lit('"none"')).otherwise(key.cast("string"))
    docs = _table(spark, sf_dir, "supplier").select(key.alias("doc_id"), _text('{"k": ', value, "}").alias("text"))
    extractor, rows = language_for("json").extractor(KeyK), []
    for name, part in (("all", docs), ("good", docs.where("doc_id % 9 <> 4"))):
        try:
            failed, first = 0, None
            extractor.verified(part)
        except ExtractionError as error:
            failed, first = error.total, error.failures[0].doc_id
        rows.append(part.agg(F.lit(name).alias("rows_of"), F.count("*").alias("n"), F.lit(failed).cast("long").alias("failed"), F.lit(first).cast("long").alias("first_failed")))
    return rows[0].unionByName(rows[1])


@query("SELECT doc_id, CAST(length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS line, CAST(strlen(list_extract(string_split(head, chr(10)), -1)) AS BIGINT) AS col FROM (SELECT doc_id, left(text, CAST(length(text) // 2 AS INTEGER)) AS head FROM documents)")
def doc_points(spark, sf_dir):
    """Line and byte column of the place in the middle of each text."""
    at = reparse.point(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", at.alias("p")).select("doc_id", F.col("p.row").cast("long").alias("line"), F.col("p.column").cast("long").alias("col"))


class Setting(OutputModel):
    __match__ = M("source_file", "assignment")
    name: str = capture("left")
    value: int = capture("right")


_SLOTS = [(kind, k) for kind in ("click", "error", "purchase", "signup", "view") for k in range(4)]


def _settings(spark, sf_dir) -> DataFrame:
    """Versions of a text for each user: every event sets one of 20 values, the text has the last of each."""
    of_user = Window.partitionBy("user_id").orderBy("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", k.alias("k"), F.row_number().over(of_user).alias("version"))
    before = of_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = [F.last(F.when((F.col("event_type") == kind) & (F.col("k") % 4 == n), F.concat(F.lit(f"{kind}{n} = "), F.col("k"), F.lit(";"))), ignorenulls=True).over(before) for kind, n in _SLOTS]
    return events.select(F.col("user_id").alias("doc_id"), "version", F.concat_ws("\n", *now).alias("text"))


@query(
    """
WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events),
later AS (SELECT *, coalesce(lead(version) OVER (PARTITION BY user_id, event_type, k % 4 ORDER BY version), 1000000000000) AS until FROM e)
SELECT v.user_id AS doc_id, CAST(v.version AS BIGINT) AS version, count(*) AS n, CAST(sum(s.k) AS BIGINT) AS total
FROM e v JOIN later s ON s.user_id = v.user_id AND s.version <= v.version AND v.version < s.until GROUP BY v.user_id, v.version
"""
)
def reparsed_versions(spark, sf_dir):
    """A stream of versions that arrive in any order, each parsed from the tree of the one before, which the state holds."""
    import uuid

    from .streaming.versions import extract_versions, replay

    # Two triggers, each of half of the files, with versions of all users in any order.
    half = max(2, spark.sparkContext.defaultParallelism)
    versions = _settings(spark, sf_dir).repartition(2 * half, F.xxhash64("doc_id", "version"))
    out = replay(versions, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", language_for("expr"), half)
    rows = extract_versions(out, language_for("expr").extractor(Setting))
    return rows.groupBy("doc_id", "version").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


from . import registry_more  # noqa: E402, F401  (registers its queries)
