"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and mixing, one after the other.

Each stage works on all rows that the one before kept, and returns the columns of documents (the last one: what the mix takes).

Defined results for odd input, in all stages: a null text has no words, so the quality rules reject it (a stage by itself keeps it as it
is: no lines, fingerprint zero, not contaminated, size 0); a null id counts as larger than every other, so of equal or near
documents the one with an id stays; of rows with equal ids any one stays, and equal rows get equal line cuts; the earliest of
equal lines is that of the least id, then line number; an empty table gives an empty result; further columns, whatever their
names, are carried to the last stage, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syntaxframe.llm import decontaminate, line_dedup, mixing, oracles, quality_rules, simhash
from syntaxframe.llm.shared import table, written

#: Jaccard similarity of five-word shingles from which documents are near duplicates.
SIMILAR = 0.8

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one are taken out of the texts (short lines: equal ones); n_chars follows."""
    out = line_dedup.line_dedup(docs, short=True).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: those that op6 links, or whose five-word shingles agree to 0.8."""
    return simhash.one_of_each(docs, share=SIMILAR)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, the others stay as they are."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mixture(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("benchmark decontamination", clean), ("mixing", mix)]

#: The same by the definitions of the stages: all pairs of equal windows, links within 2 bits, similar sets and benchmark windows.
ORACLE_SQL = oracles.pipeline_sql(SIMILAR)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
