"""Spatial maps on the model cell (H)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(length: float, width: float, bin_: float) -> tuple[int, int]:
    return math.ceil(length / bin_), math.ceil(width / bin_)


def _index(c: Column, size: float, n: int) -> Column:
    """Bin of a value in -size/2..size/2; the last bin holds its upper edge."""
    at = F.floor((c + size / 2) / (size / n))
    return F.when(c == size / 2, n - 1).otherwise(at).cast("int")


def _placed(df: DataFrame, length: float, width: float, bin_: float) -> DataFrame:
    nx, ny = bins(length, width, bin_)
    d = df.where("valid").withColumns({"bin_x": _index(F.col("mx"), length, nx), "bin_y": _index(F.col("my"), width, ny)})
    return d.where(F.col("bin_x").between(0, nx - 1) & F.col("bin_y").between(0, ny - 1))


def histogram(df: DataFrame, length: float, width: float, bin_: float) -> DataFrame:
    """bin_x, bin_y, n over valid rows (mx, my) of model_cell()."""
    return _placed(df, length, width, bin_).groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def by_class(df: DataFrame, length: float, width: float, bin_: float, label: str = "class_label") -> DataFrame:
    """class (0 for all), bin_x, bin_y, n in one pass with grouping sets."""
    d = _placed(df, length, width, bin_)
    out = d.groupingSets([[F.col("bin_x"), F.col("bin_y")], [F.col("bin_x"), F.col("bin_y"), F.col(label)]], "bin_x", "bin_y", label).agg(F.count("*").alias("n"), F.grouping(label).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, 0).otherwise(F.col(label)).alias("class"), "bin_x", "bin_y", "n")


def projection(h: DataFrame, axis: str, n: int, mirrored: bool = False) -> DataFrame:
    """class, bin, share along one axis of by_class(); mirrored takes the mean with the opposite bin."""
    s = h.groupBy("class", F.col(axis).alias("bin")).agg(F.sum("n").alias("n"))
    total = s.groupBy("class").agg(F.sum("n").alias("total"))
    s = s.join(total, "class").select("class", "bin", (F.col("n") / F.col("total")).alias("share"))
    if not mirrored:
        return s
    both = s.select("class", "bin", "share").unionByName(s.select("class", (n - 1 - F.col("bin")).alias("bin"), "share"))
    return both.groupBy("class", "bin").agg((F.sum("share") / 2).alias("share"))


def kernel(fwhm: float, bin_: float) -> list[tuple[int, int, float]]:
    """dx, dy, weight of a Gaussian out to six deviations, with unit sum."""
    sd = fwhm / (2 * math.sqrt(2 * math.log(2)))
    r = math.floor(6 * sd / bin_ + 1e-9)
    raw = [(i, j, math.exp(-((i * bin_) ** 2 + (j * bin_) ** 2) / (2 * sd * sd))) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    total = sum(w for _, _, w in raw)
    return [(i, j, w / total) for i, j, w in raw]


def reconstruction(df: DataFrame, length: float, width: float, bin_: float, fwhm: float) -> DataFrame:
    """bin_x, bin_y (from 1), weight: the kernel added at each valid point, clipped at the borders. Points are counted by position before they meet the kernel."""
    nx, ny = bins(length, width, bin_)
    spark = df.sparkSession
    k = F.broadcast(spark.createDataFrame(kernel(fwhm, bin_), "dx int, dy int, w double"))  # its size depends on the parameters alone
    px, py = F.floor((F.col("mx") + length / 2) / (length / nx) + 0.5).cast("int"), F.floor((F.col("my") + width / 2) / (width / ny) + 0.5).cast("int")
    at = df.where("valid").groupBy(px.alias("px"), py.alias("py")).agg(F.count("*").alias("n"))
    out = at.join(k, F.lit(True)).select((F.col("px") + F.col("dx")).alias("bin_x"), (F.col("py") + F.col("dy")).alias("bin_y"), (F.col("n") * F.col("w")).alias("v"))
    return out.where(F.col("bin_x").between(1, nx) & F.col("bin_y").between(1, ny)).groupBy("bin_x", "bin_y").agg(F.sum("v").alias("weight"))
