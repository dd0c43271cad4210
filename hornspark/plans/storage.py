"""Where rounds of a fixpoint are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):  # the executors could not see such a folder
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def kept(df: DataFrame, name: str = "round") -> tuple[DataFrame, str]:
    """A table written in the shared folder: no lineage, and whole if executors are lost. Also its path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
