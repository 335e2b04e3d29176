"""Scratch space that driver and executors share.

The cluster names the folder in ``spark.checkpoint.dir``.  Only where that
setting is absent and the session is local (tests, a laptop) does the library
choose one itself; a folder of one machine's own would split a cluster's data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI or path of the shared scratch folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: what is read later survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
