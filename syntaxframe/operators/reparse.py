"""What changed between two versions of a text, and documents that need parsing again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Code points that two texts share at their heads, by halving: each step compares the first halves of what is left and goes on
    with the second ones, or with the first ones if they differ. What is left shrinks by half, so all steps together read the
    texts a few times."""
    longest = F.least(F.length(a), F.length(b))

    def step(state: Column, _: Column) -> Column:
        half = F.ceil(F.length(state["a"]) / 2).cast("int")
        head_a, head_b = F.substring(state["a"], F.lit(1), half), F.substring(state["b"], F.lit(1), half)
        same = head_a == head_b
        rest_a, rest_b = F.substr(state["a"], half + 1), F.substr(state["b"], half + 1)
        return F.struct(
            (state["low"] + F.when(same, half).otherwise(0)).alias("low"), F.when(same, rest_a).otherwise(head_a).alias("a"), F.when(same, rest_b).otherwise(head_b).alias("b")
        )

    start = F.struct(F.lit(0).alias("low"), F.substring(a, F.lit(1), longest).alias("a"), F.substring(b, F.lit(1), longest).alias("b"))
    # 32 halvings reach any length.
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step)["low"]


def with_edit(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with start, old_end and new_end (code points) of the change between two text columns: the longest common head,
    then the longest common tail beside it. Each step is a column of its own, so that none is worked out twice."""
    out = df.withColumn("_head", common_prefix(F.col(old), F.col(new)))
    out = out.withColumns({"_a": F.reverse(F.substr(old, F.col("_head") + 1)), "_b": F.reverse(F.substr(new, F.col("_head") + 1))})
    out = out.withColumn("_tail", common_prefix(F.col("_a"), F.col("_b")))
    ends = {"start": F.col("_head"), "old_end": F.length(old) - F.col("_tail"), "new_end": F.length(new) - F.col("_tail")}
    return out.withColumns(ends).drop("_head", "_a", "_b", "_tail")


def byte_offset(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at))


def point(text: Column, at: Column) -> Column:
    """(row, byte column) of a code point position."""
    head = F.substring(text, F.lit(1), at)
    return F.struct((F.size(F.split(head, "\n")) - 1).alias("row"), F.octet_length(F.substring_index(head, "\n", -1)).alias("column"))


def changed(old: DataFrame, new: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``new`` whose text is not that of the same document in ``old``: only these need parsing."""
    before = old.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_hash"), F.length(text).alias("_size"))
    same = (F.col(doc) == F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")) & (F.length(text) == F.col("_size"))
    return new.join(before, same, "left_anti")
