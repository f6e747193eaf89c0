"""Tables written once to the folder that the whole cluster shares, and read back by each plan that needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster an error, for other
    machines would not see the files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_own_shared_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._own_shared_dir = folder
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: made once however many plans use it, and kept when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
