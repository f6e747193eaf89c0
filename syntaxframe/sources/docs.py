"""Documents (doc_id, text) from files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_files(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """One document a file; its path is the id. Bytes are decoded by Spark."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.decode("content", charset).alias("text"))


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line. The id is the file, the byte at which its split begins, and the line's place among the rows read with it:
    equal lines have different ids, and the same files read with the same split size give the same ids."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", place.alias("place"))
    return lines.select(F.concat_ws("#", "file_path", "file_block_start", "place").alias("doc_id"), F.col("value").alias("text"))


def from_table(df: DataFrame, doc_id: str | Column, text: str | Column, *keep: str) -> DataFrame:
    """Columns of a DataFrame as documents; only these are read from its source."""
    return df.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).alias("doc_id"), *keep, (F.col(text) if isinstance(text, str) else text).alias("text"))


def nested(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a kind as documents of their own: doc_id, outer node and line, text. Their text must have been kept."""
    return nodes.where((F.col("kind") == kind) & F.col("text").isNotNull()).select("doc_id", F.col("node_id").alias("outer_node"), F.col("start_row").alias("outer_row"), "text")


#: Input for each core that is spread over all cores before parsing, at most.
SPREAD_BYTES = 128 << 20


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, if they come from fewer files than there are cores and are small enough to move.

    Parsing costs far more than reading, and one small file is one task. Large inputs have splits enough and stay as they are.
    """
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # The size first: files are counted (in the JVM, no name leaves it) for small inputs only.
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SPREAD_BYTES:
        return docs
    return docs.repartition(cores) if 0 < len(docs._jdf.inputFiles()) < cores else docs
