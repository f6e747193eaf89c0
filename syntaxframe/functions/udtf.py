"""Table functions for SQL: parse_tree(text, grammar) and extract_json_records(text)."""

from __future__ import annotations


from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="node_id int, last_id int, parent_id int, depth int, field string, kind string, named boolean, start_byte int, end_byte int, path string, text string")
class ParseTree:
    """The nodes of a text under a grammar of the library."""

    def eval(self, text: str, grammar: str):
        from ..language import language_for
        from ..parse.rows import Wanted, tree_rows

        if text is None or grammar is None:
            return
        for row in tree_rows(language_for(grammar).parse(text), text, Wanted(children=False)):
            yield row[0], row[1], row[2], row[3], row[5], row[6], row[7], row[11], row[12], row[17], row[18]


@udtf(returnType="record int, key string, value string, kind string")
class ExtractJsonRecords:
    """Keys and values of every object in a JSON text, at any depth."""

    def eval(self, text: str):
        from ..language import language_for
        from ..parse.rows import Wanted, tree_rows

        if text is None:
            return
        want = Wanted(frozenset(("object",)), frozenset(), {"string": ("string_content",)}, frozenset(("pair",)), {"string": ("string_content",)}, False, False)
        for row in tree_rows(language_for("json").parse(text), text, want):
            for pair in row[20]:
                inner = pair["inner"]
                yield row[0], pair["key"], "".join(i["text"] for i in inner) if inner is not None else pair["value_text"], pair["value_kind"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_tree", ParseTree)
    spark.udtf.register("extract_json_records", ExtractJsonRecords)


__all__ = ["ExtractJsonRecords", "ParseTree", "register"]
