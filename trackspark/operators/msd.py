"""Mean squared displacement and diffusion (M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, frames, points, track
from ..functions.ranks import quantiles
from ..params import DEFAULT, Params


def to_um(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return df.withColumns({"x_um": F.col("x_px") * p.px_scale / 1000, "y_um": F.col("y_px") * p.px_scale / 1000})


def msd(df: DataFrame, max_lag: int | None = None, by: Sequence[str] = KEYS, p: Params = DEFAULT) -> DataFrame:
    """by..., lag, sum_sq, n, t, msd (square pixels) over all pairs of rows with the same `by`, lags up to max_lag.

    With a bound each row looks back at the rows of its last max_lag frames, in one sorted pass over each key: one exchange, on the key. Without one all pairs of a key are joined.
    Rows with nulls in `by` belong to no key.
    """
    if max_lag is None:
        a = df.select(*by, F.col("frame").alias("_f"), F.col("x_px").alias("_x"), F.col("y_px").alias("_y"))
        b = df.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("frame").alias("_g"), F.col("x_px").alias("_u"), F.col("y_px").alias("_v"))
        pairs = a.join(b, [*[F.col(c) == F.col(f"_b_{c}") for c in by], F.col("_g") > F.col("_f")]).withColumn("lag", F.col("_g") - F.col("_f"))
        d = (F.col("_u") - F.col("_x")) * (F.col("_u") - F.col("_x")) + (F.col("_v") - F.col("_y")) * (F.col("_v") - F.col("_y"))
        out = pairs.groupBy(*by, "lag").agg(F.sum(d).alias("sum_sq"), F.count("*").alias("n"))
    else:
        known = df.dropna(subset=[*by, "frame"]).select(*by, "frame", "x_px", "y_px")
        back = known.withColumn("_near", points(frames(-max_lag, -1, by)))
        square = lambda q: (F.col("x_px") - q["x"]) * (F.col("x_px") - q["x"]) + (F.col("y_px") - q["y"]) * (F.col("y_px") - q["y"])
        pairs = back.select(*by, F.explode(F.transform("_near", lambda q: F.struct((F.col("frame") - q["frame"]).alias("lag"), square(q).alias("d")))).alias("e"))
        out = pairs.groupBy(*by, F.col("e.lag").alias("lag")).agg(F.sum("e.d").alias("sum_sq"), F.count("*").alias("n"))
    return out.withColumns({"t": F.col("lag") / p.frame_rate, "msd": F.try_divide("sum_sq", "n")})


def runs(df: DataFrame, label: str = "class_label", keys: Sequence[str] = KEYS) -> DataFrame:
    """df with `run`, the number of the maximal stretch of one label that a row is in, from 0 in each track."""
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(track(keys))) | F.lag("frame").over(track(keys)).isNull(), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(track(keys).rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def _at_least(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def group_msd(df: DataFrame, max_lag: int, least: int = 2, p: Params = DEFAULT) -> DataFrame:
    """group (0 for all tracks, else the class), lag, n, t, msd (square micrometres): sums over tracks, and over runs of each class."""
    scale = (p.px_scale / 1000) ** 2
    tracks = msd(_at_least(df, KEYS, least), max_lag, p=p).withColumn("group", F.lit(0))
    by = (*KEYS, "class_label", "run")
    classes = msd(_at_least(runs(df), by, least), max_lag, by, p).withColumn("group", F.col("class_label"))
    both = tracks.select("group", "lag", "sum_sq", "n").unionByName(classes.select("group", "lag", "sum_sq", "n"))
    out = both.groupBy("group", "lag").agg(F.sum("sum_sq").alias("s"), F.sum("n").alias("n"))
    return out.select("group", "lag", "n", (F.col("lag") / p.frame_rate).alias("t"), (F.try_divide("s", "n") * scale).alias("msd"))


def longest_span(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg((F.max("frame") - F.min("frame") + 1).alias("s")).agg(F.max("s").alias("longest"))


def runs_by_class(df: DataFrame) -> DataFrame:
    return runs(df).groupBy("class_label", *KEYS).agg(F.countDistinct("run").alias("k")).groupBy("class_label").agg(F.sum("k").alias("runs"))


def equal_weight_msd(df: DataFrame, max_lag: int, p: Params = DEFAULT) -> DataFrame:
    """group (0 for whole tracks, else the class), lag, mean and standard error over the group's units (tracks, or runs of the class) of each one's mean.

    Zeros count as missing; the error of one unit is null.
    """
    scale = (p.px_scale / 1000) ** 2
    m = _unit_msd(df, max_lag, p).withColumn("v", F.when(F.col("msd") != 0, F.col("msd") * scale))
    return m.groupBy("group", "lag").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("units"))


def _unit_msd(df: DataFrame, max_lag: int, p: Params) -> DataFrame:
    by = (*KEYS, "class_label", "run")
    return msd(df, max_lag, p=p).select(F.lit(0).alias("group"), "lag", "msd").unionByName(msd(runs(df), max_lag, by, p).select(F.col("class_label").alias("group"), "lag", "msd"))


def trimmed_group_curve(df: DataFrame, max_lag: int, p: Params = DEFAULT) -> DataFrame:
    """group, lag, mean of the units' means, without the empty lags at the end of each group."""
    scale = (p.px_scale / 1000) ** 2
    m = _unit_msd(df, max_lag, p).groupBy("group", "lag").agg((F.avg(F.when(F.col("msd") != 0, F.col("msd"))) * scale).alias("mean"))
    last = F.max(F.when(F.col("mean").isNotNull(), F.col("lag"))).over(Window.partitionBy("group"))
    return m.withColumn("_last", last).where(F.col("lag") <= F.col("_last")).drop("_last")


def diffusion(curve: DataFrame, lags: int, by: str = "group", value: str = "msd", loc_prec: float | None = None, p: Params = DEFAULT) -> DataFrame:
    """A quarter of the slope of the first lags, less loc_prec per time step if given."""
    d = F.regr_slope(value, "t") / 4
    return curve.where(F.col("lag") <= lags).groupBy(by).agg((d - (loc_prec * p.frame_rate if loc_prec else 0.0)).alias("d"))


def track_diffusion(df: DataFrame, max_lag: int, by: Sequence[str] = KEYS, least: int = 5, p: Params = DEFAULT) -> DataFrame:
    """by..., d: a quarter of the slope of mean squared displacement over lags 1..max_lag, square micrometres a second, for tracks of `least` rows.

    Lags that don't occur count as 0, so that every track has a value.
    """
    units = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    middle = (max_lag + 1) / 2
    spread = sum((k - middle) ** 2 for k in range(1, max_lag + 1))
    m = msd(df, max_lag, by, p).groupBy(*by).agg(F.sum((F.col("lag") - middle) * F.col("msd")).alias("_s"))
    return units.join(m, list(by), "left").select(*by, (F.coalesce("_s", F.lit(0.0)) * ((p.px_scale / 1000) ** 2 * p.frame_rate / spread / 4)).alias("d"))


def class_diffusion(df: DataFrame, max_lag: int, unit: str = "class", p: Params = DEFAULT) -> DataFrame:
    """d for each track and class: all rows of the class pooled (unit 'class'), or each run apart ('segment')."""
    if unit == "class":
        return track_diffusion(df, max_lag, (*KEYS, "class_label"), p=p)
    return track_diffusion(runs(df), max_lag, (*KEYS, "class_label", "run"), p=p)


def histogram(d: DataFrame, width: float, value: str = "d", by: str | None = None, low: Column | None = None) -> DataFrame:
    """(by), bin, low, n with edges shared by all groups, starting at the minimum."""
    least = low
    if least is None:
        d = d.join(F.broadcast(d.agg(F.min(value).alias("_least"))), F.lit(True))  # one row
        least = F.col("_least")
    binned = d.withColumn("bin", F.floor((F.col(value) - least) / width)).withColumn("low", least + F.col("bin") * width)
    return binned.groupBy(*([by] if by else []), "bin").agg(F.min("low").alias("low"), F.count("*").alias("n"))


def gamma_mixture(d: DataFrame, components: int, shape: float, rounds: int = 40, value: str = "d") -> DataFrame:
    """component, mean, occupancy, log_likelihood of a mixture of gamma densities of fixed shape, by expectation maximisation.

    Each round is one aggregate over the table with responsibilities as columns; only the parameters come to the driver. The starts are quantiles.
    """
    spark = d.sparkSession
    x = d.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x")).persist()
    try:
        found = _fit_gammas(x, components, shape, rounds)
    finally:
        x.unpersist()
    return spark.createDataFrame(found, "component int, mean double, occupancy double, log_likelihood double")


def _fit_gammas(x: DataFrame, components: int, shape: float, rounds: int) -> list[tuple]:
    import math

    n = x.count()
    if not n:
        return []
    starts = quantiles(x, [], "x", [(k + 0.5) / components for k in range(components)]).collect()  # a row a component
    means = sorted(max(r["v"], 1e-12) for r in starts)
    means = [m * (1 + 1e-3 * k) for k, m in enumerate(means)]
    shares = [1 / components] * components
    loglik = 0.0
    for _ in range(rounds):
        logs = [F.lit(math.log(max(s, 1e-300)) + shape * math.log(shape / m) - math.lgamma(shape)) + (shape - 1) * F.log("x") - shape * F.col("x") / m for s, m in zip(shares, means, strict=True)]
        top = F.greatest(*logs) if components > 1 else logs[0]
        terms = [F.exp(v - top) for v in logs]
        whole = sum(terms[1:], terms[0])
        r = [t / whole for t in terms]
        got = x.agg(F.sum(top + F.log(whole)).alias("ll"), *[F.sum(v).alias(f"r{k}") for k, v in enumerate(r)], *[F.sum(v * F.col("x")).alias(f"x{k}") for k, v in enumerate(r)]).first()
        shares = [got[f"r{k}"] / n for k in range(components)]
        means = [max(got[f"x{k}"] / max(got[f"r{k}"], 1e-300), 1e-12) for k in range(components)]
        if abs(got["ll"] - loglik) < 1e-9 * abs(got["ll"]):
            loglik = got["ll"]
            break
        loglik = got["ll"]
    return [(k, m, s, loglik) for k, (m, s) in enumerate(sorted(zip(means, shares, strict=True)))]


def mixture_residuals(d: DataFrame, mixture: DataFrame, shape: float, width: float, value: str = "d") -> DataFrame:
    """bin, centre, n, fit, residual: a histogram of the values above 0 from 0 on, less what a mixture (component, mean, occupancy) expects at the middle of each bin.

    Empty bins between the first and the last have rows too.
    """
    import math

    bins = d.where(F.col(value) > 0).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = bins.agg(F.max("bin").alias("last"), F.sum("n").alias("all")).where("last IS NOT NULL")  # one row
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"), "all")
    x, m = (F.col("bin") + 0.5) * width, F.col("mean")
    density = F.exp(shape * F.log(shape / m) + (shape - 1) * F.log(x) - shape * x / m - math.lgamma(shape))
    fit = grid.join(F.broadcast(mixture.select("mean", "occupancy")), F.lit(True)).groupBy("bin").agg(F.sum(F.col("occupancy") * density * F.col("all") * width).alias("fit"))  # a row a component
    full = fit.join(bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("bin", ((F.col("bin") + 0.5) * width).alias("centre"), "n", "fit", (F.col("n") - F.col("fit")).alias("residual"))
