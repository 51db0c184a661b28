"""What several operators of this subpackage need: input tables, shared storage and Arrow mapping."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    return f"{base.rstrip('/')}/trackspark-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: later stages, retries and lost executors start from the table."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: StructType | str) -> DataFrame:
    """fn over each Arrow batch of df; the number of partitions stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about so many bytes in a column of texts; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """What a Python worker has freed goes back to the system; its allocators would keep it while the worker waits for other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # not in every C library
        trim(0)


def range_cuts(df: DataFrame, key: str, rows: int) -> list[int]:
    """The values of a whole-number column at every rows-th rank, which cut df into ranges of so many rows; ties stay together.

    The ids are sorted once and written with their places, so the cuts depend on the ids alone, not on partitions. Only the cuts
    and a count for each partition come to the driver.
    """
    ids = df.select(F.col(key).cast("long").alias("v")).where("v IS NOT NULL").sort("v")
    placed = written(ids.select("v", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")))
    before, offsets = 0, []
    for r in placed.groupBy("p").count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    rows = max(rows, -(-before // 100_000))
    if before <= rows:
        return []
    starts = df.sparkSession.createDataFrame(offsets, "p int, o long")  # a row a partition
    rank = F.col("o") + F.col("i")
    cuts = placed.join(F.broadcast(starts), "p").where((rank > 0) & (rank % rows == 0)).select("v").collect()
    return sorted({r["v"] for r in cuts})


def range_of(key: str, cuts: list[int]) -> Column:
    """The number of cuts at or below a value; nulls are in the first range."""
    if not cuts:
        return F.lit(0)
    at = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(), side="right")).astype("int32")

    return place(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
