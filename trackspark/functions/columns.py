"""Column expressions and window frames that the operators share.

Every per-track operator partitions by KEYS and orders by frame, so that one exchange on the track key serves all of them.
Frame-range windows are RANGE windows: gaps are legal, and a window of w frames is not w rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("cell_id", "mol_id")


def track(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("frame")


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return track(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def frames(low: int, high: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    return track(keys).rangeBetween(low, high)


def step_px(keys: Sequence[str] = KEYS) -> Column:
    """Distance from the previous row, pixels; null on the first."""
    w = track(keys)
    return F.hypot(F.col("x_px") - F.lag("x_px").over(w), F.col("y_px") - F.lag("y_px").over(w))


def points(w: WindowSpec) -> Column:
    """The rows of a window as an array of (frame, x, y), in frame order. A window is a few frames, so the array is short."""
    return F.collect_list(F.struct(F.col("frame"), F.col("x_px").alias("x"), F.col("y_px").alias("y"))).over(w)


def after(a: Column, k: int = 1) -> Column:
    """a without its first k entries."""
    return F.slice(a, k + 1, F.size(a))


def dist(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def steps_of(p: Column) -> Column:
    """Distances of consecutive points of an array: the steps that lie inside a window."""
    return F.transform(after(p), lambda q, i: dist(q, p[i]))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def central(a: Column, power: int) -> Column:
    """Sum of powers of differences from the mean; a must be a column of the row, not a long expression."""
    m = mean_of(a)
    return total(F.transform(a, lambda x: F.pow(x - m, F.lit(power))))


def std_of(a: Column) -> Column:
    return F.sqrt(F.try_divide(central(a, 2), F.size(a) - 1))


def running_std(a: Column) -> Column:
    """std_of(), entry after entry by Welford's sums: equal to the last digit to an engine's sample deviation over the entries in this order."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(a, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))))


def slope(xy: Column) -> Column:
    """Least-squares slope of an array of (t, v); null with fewer than two distinct t."""
    n = F.size(xy)
    sx, sy = total(F.transform(xy, lambda p: p["t"])), total(F.transform(xy, lambda p: p["v"]))
    sxy, sxx = total(F.transform(xy, lambda p: p["t"] * p["v"])), total(F.transform(xy, lambda p: p["t"] * p["t"]))
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def pairs_of(p: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(earlier, later) for all pairs of an array of points."""
    return F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda b: make(a, b))))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def turn(ex: Column, ey: Column, dx: Column, dy: Column) -> Column:
    """Signed angle from step (ex, ey) to step (dx, dy), radians; after a step without length that to the x axis, and 0 for one (a zero's sign doesn't count)."""
    turned = F.atan2(cross(ex, ey, dx, dy) + F.lit(0.0), ex * dx + ey * dy + F.lit(0.0))
    return F.when((ex == 0) & (ey == 0), F.atan2(dy + F.lit(0.0), dx + F.lit(0.0))).otherwise(turned)


def rounded(c: Column, digits: int = 4) -> Column:
    """For comparing results, as DuckDB rounds: the scaled value, half away from zero, and scaled back; negative zero becomes zero.

    Spark's own rounding goes by the decimal text, so it differs where scaling rounds to a half, and in the last digit of large values.
    """
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)


def keyed(seed: int, *by: str | Column) -> Column:
    """The MD5 digest, in hexadecimal, of the seed and the columns' decimal texts between bars: one that any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in by]).cast("binary"))
