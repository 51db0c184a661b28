"""Running sums, ranks and quantiles over keys of any size, without putting a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums (new name: column), its running sum over `order` in each key of `by`, up to and with the row.

    Rows are dealt by ranges of (by, order), so a large key takes many tasks. Each range sums its own rows; a row a range and key, added up before, says
    what came earlier. Ties in `order` get sums in any sequence, so rows that tie must not differ in what they add, or the caller must not mind.
    """
    return _running(_ranged(df, by, order), df.columns, by, order, sums)


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written sorted by ranges, with the number of each row's range."""
    return written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id()))


def _running(at: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    totals = at.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = at.withColumns({f"_s{i}": F.sum(c).over(within) for i, c in enumerate(sums.values())})
    same = [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    out = {name: F.col(f"_s{i}") + F.col(f"_b{i}") for i, name in enumerate(sums)}
    return own.join(base, same).select(*columns, *[c.alias(name) for name, c in out.items()])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, kind: str = "int") -> DataFrame:
    """df with the number of each row in its key, from 1; rows must differ in `order`."""
    one = df.withColumn("_one", F.lit(1))
    return running(one, by, order, {name: "_one"}).drop("_one").withColumn(name, F.col(name).cast(kind))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by..., i, share, v: exact quantiles of a column in each key, interpolated between neighbouring values. Nulls don't count.

    Equal values are counted before anything is shuffled, and ranks are running sums of those counts; a quantile looks up two ranks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    at = _ranged(counts, by, ["_v"])
    ranked = _running(at, counts.columns, by, ["_v"], {"_after": "_n"})
    total = at.groupBy(*by).agg(F.sum("_n").alias("_all"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("share")) for i, q in enumerate(shares)])
    places = total.select(*by, "_all", F.explode(wanted).alias("e")).select(*by, "e.i", "e.share", ((F.col("_all") - 1) * F.col("e.share")).alias("_at"))
    # a row a key and quantile, twice: the value at the rank below, and at the one above
    ranks = places.select(*by, "i", "share", F.explode(F.array(F.struct(F.floor("_at").alias("rank"), (1 - (F.col("_at") - F.floor("_at"))).alias("w")), F.struct((F.floor("_at") + 1).alias("rank"), (F.col("_at") - F.floor("_at")).alias("w")))).alias("e"))
    ranks = ranks.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(by)], "i", "share", "e.rank", "e.w").where("w > 0")
    same = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(by)]
    hit = ranked.join(F.broadcast(ranks) if not by else ranks, [*same, F.col("rank") >= F.col("_after") - F.col("_n"), F.col("rank") < F.col("_after")])
    return hit.groupBy(*by, "i", "share").agg(F.sum(F.col("w") * F.col("_v")).alias("v"))
