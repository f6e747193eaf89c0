"""Helpers that all operators use: the folder that the cluster shares, tables written into it, and id handling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging

#: Stands for a null document id in comparisons: a document without an id comes after all others.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in local mode only, a folder of our own."""
    return staging.shared_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # zstd: smaller than the default, and its buffers are given back when a file is closed.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_if_null(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of the taken ones has."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
