"""Connected components of edges between rows of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as a star for each of its components: every other node (hi) with the least one (lo)."""
    root: dict[int, int] = {}

    def find(n: int) -> int:
        top = n
        while root[top] != top:
            top = root[top]
        while root[n] != top:
            root[n], n = top, root[n]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    hi = [n for n in root if root[n] != n]
    out = pa.table({"lo": pa.array([find(n) for n in hi], pa.int64()), "hi": pa.array(hi, pa.int64())})
    yield from out.to_batches(max_chunksize=10_000)


def components(edges: DataFrame) -> DataFrame:
    """node, label: for edges (a, b) of long numbers, the least node that each node is connected with. Nodes without edges don't occur.

    Each partition first replaces its edges by stars. Rounds over all edges follow: nodes hang their larger neighbours on the least one near, then their smaller ones,
    until there are stars only; their number grows with the logarithm of what is left, so edges that lie together should be in one partition. A round
    is grouped minima and joins of slim rows, and is written, so lineage stays short.
    """
    now = written(edges.where("a <> b").mapInArrow(_contracted, "lo long, hi long").distinct())
    while True:
        # stars only: no centre hangs on another node, and nobody hangs on two
        centres = now.select(F.col("lo").alias("hi")).distinct().join(now, "hi", "left_semi").select("hi")
        twice = now.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        if not centres.unionByName(twice).limit(1).count():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("top"))
        large = both.join(least, "n").where("m > n").select(F.col("top").alias("lo"), F.col("m").alias("hi")).where("lo <> hi").distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("top"))
        small = large.join(first, "hi").select(F.col("top").alias("x"), F.col("lo").alias("y")).unionByName(first.select(F.col("top").alias("x"), F.col("hi").alias("y")))
        now = written(small.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
