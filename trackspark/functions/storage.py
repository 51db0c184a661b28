"""Folders that all executors see, and tables in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors see.

    It is under spark.checkpoint.dir; where that is unset, under the context's checkpoint folder; else, on a cluster, under the warehouse, unless that is a folder of one
    machine, which is an error; and in a local session, whose driver and executors are one machine, in a temporary folder, which is set as spark.checkpoint.dir.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        if base.startswith(("file:", "/")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors see; {base} is on one machine")
    if not base:
        base = tempfile.mkdtemp(prefix="trackspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracks-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: what follows starts from the table."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
