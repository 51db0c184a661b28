"""Statistics and ranking of features (X)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, keyed, track
from ..functions.ranks import numbered, quantiles, running
from ..functions.storage import written
from .prepare import crop

BINS = 25


def rows_with_class(df: DataFrame, features: Sequence[str], label: str = "class_label") -> DataFrame:
    return df.select(*features, F.col(label).alias("class"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """a, b, r for every pair of features from one aggregate of sums; constant features have null."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]

    def r(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    s = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))
    return s.unionByName(s.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("e")).select(*keep, "e.*")


def binned(df: DataFrame, features: Sequence[str], keep: Sequence[str], bins: int = BINS) -> DataFrame:
    """keep..., feature, bin: quantile bins with distinct edges; the last holds its upper edge. All features in one pass; edges are a row a feature.

    Edges and values are compared to six places, so that interpolated edges fall on the values they stem from.
    """
    long = melt(df, features, keep).where("value IS NOT NULL")
    cut = quantiles(long.select("feature", "value"), ["feature"], "value", [k / bins for k in range(bins + 1)])
    cuts = cut.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list(F.round("v", 6)))).alias("edges"))  # a row a feature
    b = F.size(F.filter("edges", lambda e: e <= F.round("value", 6)))
    return long.join(F.broadcast(cuts), "feature").withColumn("bin", F.least(b, F.greatest(F.size("edges") - 1, F.lit(1)))).drop("edges", "value")


def mutual_information(df: DataFrame, features: Sequence[str], label: str = "class_label", bins: int = BINS) -> DataFrame:
    """feature, mi (bits) with the class, for a list of features in one job."""
    c = binned(df, features, [label], bins).groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    return _information(c, ["feature"], "bin", label)


def _information(c: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    w = lambda *x: Window.partitionBy(*by, *x)
    s = c.withColumns({"na": F.sum("n").over(w(a)), "nb": F.sum("n").over(w(b)), "all": F.sum("n").over(w())})
    return s.groupBy(*by).agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))


def pairwise_information(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """a, b, mi for every pair of features: bins of a row side by side, counted for all pairs at once."""
    row = [*KEYS, "frame"]
    own = binned(df, features, row, bins)
    wide = own.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("feature", "bin"))).alias("m"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("m")[a].alias("x"), F.col("m")[b].alias("y")) for a, b in pairs])).alias("e")).select("e.*")
    c = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    return _information(c, ["a", "b"], "x", "y")


def proximal(df: DataFrame, reach: int, label: str = "class_label") -> DataFrame:
    """df with proximal: the row is among those from reach - 1 before to reach after a row whose successor has another label."""
    cp = F.when(F.lead(label).over(track()) != F.col(label), 1).otherwise(0)
    return df.withColumn("_cp", cp).withColumn("proximal", F.max("_cp").over(track().rowsBetween(-reach, reach - 1)) == 1).drop("_cp")


def ranked(scores: DataFrame, value: str = "mi") -> DataFrame:
    """Features by falling score, ties by name. A row a feature."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "feature")))


def ranked_by_regions(df: DataFrame, features: Sequence[str], reach: int, label: str = "class_label") -> DataFrame:
    """feature, proximal, distal, total information, ranked by total."""
    d = proximal(df, reach, label)
    a = mutual_information(d.where("proximal"), features, label).withColumnRenamed("mi", "near")
    b = mutual_information(d.where("NOT proximal"), features, label).withColumnRenamed("mi", "far")
    return ranked(a.join(b, "feature", "full").select("feature", F.coalesce("near", F.lit(0.0)).alias("near"), F.coalesce("far", F.lit(0.0)).alias("far")).withColumn("total", F.col("near") + F.col("far")), "total")


def discover(df: DataFrame, used: Sequence[str], others: Sequence[str], most_r: float, least_mi: float, label: str = "class_label", show: str = "predictive") -> DataFrame:
    """Unused features ranked by information on the class, with predictive: whether it reaches least_mi.

    show: `all` of them; those that no used feature correlates with beyond most_r (`new`); or of these the predictive ones (`predictive`).
    """
    mi = mutual_information(df, others, label)
    if show != "all":
        r = correlations(df, [*used, *others])
        close = r.where(F.col("a").isin(*others) & F.col("b").isin(*used) & (F.abs("r") > most_r)).select(F.col("a").alias("feature")).distinct()
        mi = mi.join(close, "feature", "left_anti")
    mi = mi.withColumn("predictive", F.col("mi") >= least_mi)
    return ranked(mi.where("predictive") if show == "predictive" else mi)


def regions(df: DataFrame, a: int, b: int, reach: int, which: str = "all", label: str = "class_label", start: int = 0, end: int = 0) -> DataFrame:
    """Rows of cropped tracks with class a or b, for distributions: `all` rows of the two classes; `distal`, those not around a change of class;
    or `proximal`, all rows around changes between the two, whose class is the one before the change; a row near two changes counts for each."""
    d = crop(df, start, end)
    if which == "all":
        return d.where(F.col(label).isin(a, b)).withColumn("class", F.col(label))
    if which == "distal":
        return proximal(d, reach, label).where(F.col(label).isin(a, b) & ~F.coalesce("proximal", F.lit(False))).withColumn("class", F.col(label)).drop("proximal")
    before = F.when((F.col(label) == a) & (F.lead(label).over(track()) == b), a).when((F.col(label) == b) & (F.lead(label).over(track()) == a), b)
    near = F.collect_list("_from").over(track().rowsBetween(-reach, reach - 1))
    return d.withColumn("_from", before).withColumn("_near", near).withColumn("class", F.explode("_near")).drop("_from", "_near")


def point_histogram(d: DataFrame, feature: str, points: int) -> DataFrame:
    """class, bin, x (its middle), density of regions(): for each class, so many bins from its least to its largest value."""
    v = d.where(F.col(feature).isNotNull()).select("class", F.col(feature).cast("double").alias("v"))
    ends = v.groupBy("class").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all"))  # a row a class
    width = (F.col("hi") - F.col("lo")) / points
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(points - 1))
    n = v.join(F.broadcast(ends), "class").where("hi > lo").groupBy("class", "lo", "hi", "all", at.alias("bin")).agg(F.count("*").alias("n"))
    return n.select("class", "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("x"), (F.col("n") / F.col("all") / width).alias("density"))


def positive_density(d: DataFrame, feature: str, bandwidth: float, points: int) -> DataFrame:
    """class, x, density of regions() for a feature without negative values: zeros are left out, and the kernel works on logarithms, so none of it falls below 0.

    The grid is even in the logarithm from three bandwidths below the least value to three above the largest, as many points for each class. Rows are counted
    by value before they meet the grid.
    """
    import math

    v = d.where(F.col(feature) > 0).groupBy("class", F.log(F.col(feature).cast("double")).alias("v")).agg(F.count("*").alias("n"))
    ends = v.groupBy("class").agg((F.min("v") - 3 * bandwidth).alias("lo"), (F.max("v") + 3 * bandwidth).alias("hi"), F.sum("n").alias("all"))
    grid = ends.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("u", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (points - 1))
    z = (F.col("v") - F.col("u")) / bandwidth
    s = v.join(F.broadcast(grid), "class").groupBy("class", "u", "all").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("s"))
    return s.select("class", F.exp("u").alias("x"), (F.col("s") / (F.col("all") * bandwidth * math.sqrt(2 * math.pi)) / F.exp("u")).alias("density"))


def class_distribution(df: DataFrame, feature: str, width: float, label: str = "class_label") -> DataFrame:
    """class, bin, density: histogram of a feature for each class."""
    h = df.where(F.col(feature).isNotNull()).groupBy(F.col(label).alias("class"), F.floor(F.col(feature) / width).alias("bin")).agg(F.count("*").alias("n"))
    return h.select("class", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("class")) / width).alias("density"))


def smoothed_distribution(h: DataFrame, sd: float) -> DataFrame:
    """Gaussian smoothing of class_distribution() over bins, out to three deviations."""
    import math

    r = math.ceil(3 * sd)
    raw = [(k, math.exp(-(k * k) / (2 * sd * sd))) for k in range(-r, r + 1)]
    total = sum(w for _, w in raw)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(w / total).alias("w")) for k, w in raw]))
    return h.withColumn("k", kernel).groupBy("class", (F.col("bin") + F.col("k")["d"]).alias("bin")).agg(F.sum(F.col("density") * F.col("k")["w"]).alias("density"))


def kernel_density(df: DataFrame, feature: str, low: float, high: float, n: int, bandwidth: float, label: str = "class_label") -> DataFrame:
    """class, x, density on a grid: each row adds to the points of the grid, an array in the row, before anything is shuffled."""
    import math

    step = (high - low) / (n - 1)
    z = (F.col(feature) - (low + F.col("g") * step)) / bandwidth
    total = df.where(F.col(feature).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    d = df.where(F.col(feature).isNotNull()).select(F.col(label), F.col(feature), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"))
    s = d.groupBy(label, "g").agg(F.sum(F.exp(-z * z / 2)).alias("s")).join(total, label)
    return s.select(F.col(label).alias("class"), (low + F.col("g") * step).alias("x"), (F.col("s") / (F.col("_n") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def kolmogorov_smirnov(df: DataFrame, feature: str, a: int, b: int, label: str = "class_label") -> DataFrame:
    """d: the largest difference of two classes' cumulative distributions. Rows are counted by value first; the counts are summed up over ranges of values."""
    c = df.where(F.col(label).isin(a, b) & F.col(feature).isNotNull()).groupBy(feature).agg(F.sum(F.when(F.col(label) == a, 1).otherwise(0)).alias("x"), F.sum(F.when(F.col(label) == b, 1).otherwise(0)).alias("y"))
    s = running(c, [], [feature], {"cx": "x", "cy": "y"})
    t = c.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return s.join(F.broadcast(t), F.lit(True)).agg(F.max(F.abs(F.try_divide("cx", F.col("nx")) - F.try_divide("cy", F.col("ny")))).alias("d"))


def masked_accuracy(df: DataFrame, truth: str, predicted: str, mask: Column | None = None) -> DataFrame:
    m = F.lit(True) if mask is None else mask
    return df.agg(F.avg(F.when(m, (F.col(truth) == F.col(predicted)).cast("double"))).alias("accuracy"), F.sum(F.when(m, 1).otherwise(0)).alias("rows"))


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 0, order: Sequence[str] = (*KEYS, "frame")) -> DataFrame:
    """feature, importance, std, rank: baseline less the score with one feature dealt anew over all rows, repeated; score(df) gives one row with `accuracy`."""
    df = written(df)
    base = score(df).first()["accuracy"]
    lost = [(f, base - score(shuffled(df, f, seed * 1000 + k, order)).first()["accuracy"]) for f in features for k in range(repeats)]
    d = df.sparkSession.createDataFrame(lost, "feature string, loss double")  # a row a feature and repeat
    return ranked(d.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_samp("loss").alias("std")), "importance")


def shuffled(df: DataFrame, feature: str, seed: int, order: Sequence[str]) -> DataFrame:
    """df with one feature dealt anew over all rows, which must differ in `order` and have no nulls there.

    Rows are numbered twice, by `order` and by a seeded digest of it; a row gets the value of the row that has its first number as the second one. Both numberings
    go over ranges, so no task holds all rows, and any engine can repeat them. Sorted numbers make tiny files, by which Spark would take millions of rows for
    something to broadcast, so the joins are told to sort and merge.
    """
    slim = df.select(*order, feature).withColumn("_h", keyed(seed, *order))
    mine = numbered(slim.select(*order), [], order, "_r", "long")
    theirs = numbered(slim, [], ["_h", *order], "_r", "long").select("_r", feature)
    dealt = mine.hint("merge").join(theirs.hint("merge"), "_r").drop("_r")
    return df.drop(feature).join(dealt.hint("merge"), list(order)).select(df.columns)
