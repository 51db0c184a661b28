"""Features of each row of a track (E). Each operator takes tracks (cell_id, mol_id, frame, x_px, y_px, ...) and adds its columns.

Rows of one track must have distinct frames. Undefined ratios are null; where a definition says zero (first rows, too few rows), it is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import KEYS, after, central, cross, dist, frames, mean_of, pairs_of, points, running_std, slope, std_of, step_px, steps_of, total, track, turn, whole
from ..params import DEFAULT, Params


def positions_nm(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return df.withColumns({"x_nm": F.col("x_px") * p.px_scale, "y_nm": F.col("y_px") * p.px_scale})


def step_size(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("step_nm", F.coalesce(step_px(keys), F.lit(0.0)) * p.px_scale)


def _stepped(df: DataFrame, p: Params, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_step", F.coalesce(step_px(keys), F.lit(0.0)) * p.px_scale)


def time_step(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("time_step", F.coalesce((F.col("frame") - F.lag("frame").over(track(keys))) / p.frame_rate, F.lit(0.0)))


def experiment_time(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return df.withColumn("time", F.col("frame") / p.frame_rate)


def time_from_start(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("time_from_start", (F.col("frame") - F.first("frame").over(track(keys))) / p.frame_rate)


def time_from_references(df: DataFrame, references: dict[str, float], p: Params = DEFAULT) -> DataFrame:
    """Time from named reference times (s)."""
    return df.withColumns({f"time_from_{name}": F.col("frame") / p.frame_rate - t for name, t in references.items()})


def distance_from_start(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    w = track(keys)
    return df.withColumn("from_start_nm", F.hypot(F.col("x_px") - F.first("x_px").over(w), F.col("y_px") - F.first("y_px").over(w)) * p.px_scale)


def distance_travelled(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return _stepped(df, p, keys).withColumn("travelled_nm", F.sum("_step").over(track(keys).rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def track_position(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    w, all_ = track(keys), whole(keys)
    row, n = F.row_number().over(w), F.count("*").over(all_)
    return df.withColumns({"rows_from_start": row - 1, "rows_to_end": n - row, "frames_from_start": F.col("frame") - F.first("frame").over(all_), "frames_to_end": F.last("frame").over(all_) - F.col("frame")})


def _moves(keys: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    w = track(keys)
    x, y = F.col("x_px"), F.col("y_px")
    return x - F.lag(x).over(w), y - F.lag(y).over(w), F.lag(x).over(w) - F.lag(x, 2).over(w), F.lag(y).over(w) - F.lag(y, 2).over(w)


def image_angle(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Absolute angle of the step to the x axis, degrees; 0 on the first row."""
    dx, dy, _, _ = _moves(keys)
    return df.withColumn("image_angle", F.coalesce(F.abs(F.degrees(F.atan2(dy, dx))), F.lit(0.0)))


def turn_angle_of(keys: Sequence[str] = KEYS) -> Column:
    dx, dy, ex, ey = _moves(keys)
    return F.coalesce(F.abs(F.degrees(turn(ex, ey, dx, dy))), F.lit(0.0))


def turn_angle(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Absolute angle of the step to the one before, degrees; 0 on the first two rows."""
    return df.withColumn("turn_angle", turn_angle_of(keys))


def signed_angles(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Image angle and turn angle, radians with sign; null where undefined."""
    dx, dy, ex, ey = _moves(keys)
    return df.withColumns({"image_rad": F.atan2(dy, dx), "turn_rad": turn(ex, ey, dx, dy)})


def turn_angle_simple(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unsigned turn angle by the normalised dot product, degrees; null where a step has no length."""
    dx, dy, ex, ey = _moves(keys)
    share = F.try_divide(ex * dx + ey * dy, F.hypot(dx, dy) * F.hypot(ex, ey))
    return df.withColumn("turn_simple", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))))


def cell_axis_angle(df: DataFrame, axes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angle of the step to the long axis of its cell, folded to 0..90 degrees; 0 on the first row. axes: cell_id, ax, ay."""
    dx, dy, _, _ = _moves(keys)
    a = df.withColumns({"_dx": dx, "_dy": dy}).join(axes, "cell_id", "left")
    angle = F.degrees(F.atan2(F.abs(cross(F.col("ax"), F.col("ay"), F.col("_dx"), F.col("_dy"))), F.col("ax") * F.col("_dx") + F.col("ay") * F.col("_dy")))
    return a.withColumn("cell_angle", F.coalesce(F.when(angle > 90, 180 - angle).otherwise(angle), F.lit(0.0))).drop("_dx", "_dy", "ax", "ay")


def spot_size(df: DataFrame, p: Params = DEFAULT, a: str = "sigma_x_px", b: str = "sigma_y_px") -> DataFrame:
    return df.withColumn("spot_size", 2 * F.sqrt(F.pow(F.col(a) * p.px_scale, 2) + F.pow(F.col(b) * p.px_scale, 2)))


def spot_area(df: DataFrame, p: Params = DEFAULT, a: str = "sigma_x_px", b: str = "sigma_y_px") -> DataFrame:
    return df.withColumn("spot_area", F.pi() * F.col(a) * F.col(b) * p.px_scale**2)


def shifted_steps(df: DataFrame, before: int, ahead: int, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Step sizes of the rows at each shift from -before to +ahead, 0 beyond the track."""
    s, w = _stepped(df, p, keys), track(keys)
    back = {f"step_m{k}": F.lag("_step", k, 0.0).over(w) for k in range(1, before + 1)}
    return s.withColumns(back | {f"step_p{k}": F.lead("_step", k, 0.0).over(w) for k in range(1, ahead + 1)}).drop("_step")


SMOOTHERS = ("movmean", "movmedian", "gaussian", "lowess", "loess", "rlowess", "rloess", "sgolay")


def smoothed_steps(df: DataFrame, method: str = "movmean", width: int = 5, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Step sizes smoothed over `width` rows; the first row is 0 and takes no part. An even width has one row more before than after.

    lowess and loess weight neighbours by the tricube of their distance and fit a line or a parabola; the forms with r repeat that
    with bisquare weights of the residuals; sgolay fits a parabola without weights.
    """
    if method not in SMOOTHERS:
        raise ValueError(f"{method} is none of {SMOOTHERS}")
    if width < 1:
        raise ValueError("a width of at least one row is needed")
    before, after = width // 2, (width - 1) // 2
    s = _stepped(df, p, keys).withColumn("_rn", F.row_number().over(track(keys)))
    rows = track(keys).rowsBetween(-before, after)
    use = F.when(F.col("_rn") > 1, F.col("_step"))
    if method == "movmean":
        value = F.avg(use).over(rows)
    elif method == "movmedian":
        s = s.withColumn("_near", F.array_sort(F.collect_list(use).over(rows)))
        n = F.size("_near")
        value = F.when(n > 0, (F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2)
    elif method == "gaussian":
        near = F.collect_list(F.when(F.col("_rn") > 1, F.struct("_rn", "_step"))).over(rows)
        weight = lambda q: F.exp(-F.pow((q["_rn"] - F.col("_rn")) / F.lit(width / 5), 2) / 2)
        value = F.try_divide(total(F.transform(near, lambda q: weight(q) * q["_step"])), total(F.transform(near, weight)))
    elif method[0] == "r":
        return _robust_fits(s, method, before, after, keys)
    else:
        near = F.collect_list(F.when(F.col("_rn") > 1, F.struct("_rn", "_step"))).over(rows)
        s = s.withColumn("_near", near).withColumn("_near", F.transform("_near", lambda q: F.struct((q["_rn"] - F.col("_rn")).cast("double").alias("d"), q["_step"].alias("y"))))
        reach = F.array_max(F.transform("_near", lambda q: F.abs(q["d"]))) + 1
        weight = (lambda q: F.lit(1.0)) if method == "sgolay" else (lambda q: F.pow(1 - F.pow(F.abs(q["d"]) / F.col("_reach"), 3), 3))
        s = s.withColumn("_reach", reach)

        def moment(k: int, y: bool) -> Column:
            return total(F.transform("_near", lambda q: weight(q) * F.pow(q["d"], F.lit(k)) * (q["y"] if y else F.lit(1.0))))

        s = s.withColumns({f"_s{k}": moment(k, False) for k in range(5)} | {f"_t{k}": moment(k, True) for k in range(3)})
        n = F.size("_near")
        value = F.when(n < 2, F.try_divide("_t0", F.col("_s0")))
        s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(f"_{c}") for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
        line = F.try_divide(s2 * t0 - s1 * t1, s0 * s2 - s1 * s1)
        if method == "lowess":
            value = value.otherwise(line)
        else:
            parabola = F.try_divide(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2), s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))
            value = value.when(n < 3, line).otherwise(parabola)
        s = s.withColumn("_value", F.when(n > 0, value)).drop("_reach", *[f"_s{k}" for k in range(5)], *[f"_t{k}" for k in range(3)])
        value = F.col("_value")
    return s.withColumn("smoothed_nm", F.when(F.col("_rn") == 1, 0.0).otherwise(value)).drop("_step", "_rn", "_near", "_value")


def _robust_fits(s: DataFrame, method: str, before: int, after: int, keys: Sequence[str]) -> DataFrame:
    """Five rounds of local fits over whole tracks, all rows of a track at once; the weights of a round depend on the track's median residual."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    degree = 1 if method.endswith("lowess") else 2

    def smooth(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("frame")
        y = t["_step"].to_numpy()[1:]
        at = np.arange(len(y))[:, None] + np.arange(-before, after + 1)
        there = (at >= 0) & (at < len(y))
        at, d = np.clip(at, 0, max(0, len(y) - 1)), np.arange(-before, after + 1.0)
        reach = np.where(there, np.abs(d), 0).max(axis=1, keepdims=True) + 1
        local = np.where(there, (1 - np.minimum(1, np.abs(d) / reach) ** 3) ** 3, 0.0)
        out, robust = y.copy(), np.ones(len(y))
        for _ in range(5 if len(y) else 0):
            k = local * robust[at]
            n = np.minimum(degree, (k > 0).sum(axis=1) - 1)
            powers = d[:, None] ** np.arange(degree + 1)
            left = np.einsum("rw,wi,wj->rij", k, powers, powers)
            right = np.einsum("rw,wi,rw->ri", k, powers, y[at])
            for m in range(degree + 1):  # rows with fewer weights than the fit needs take a lower degree
                rows = np.flatnonzero(n == m)
                if len(rows):
                    out[rows] = np.linalg.solve(left[rows, : m + 1, : m + 1], right[rows, : m + 1, None])[:, 0, 0]
            out[n < 0] = y[n < 0]
            spread = 6 * np.median(np.abs(y - out))
            if spread > 0:
                robust = np.where(np.abs(y - out) < spread, (1 - ((y - out) / spread) ** 2) ** 2, 0.0)
        return t.assign(smoothed_nm=np.concatenate([[0.0], out])).drop(columns=["_step", "_rn"])

    schema = StructType([*[f for f in s.schema.fields if f.name not in ("_step", "_rn")], StructField("smoothed_nm", DoubleType())])
    return s.groupBy(*keys).applyInPandas(smooth, schema)


def _msd_by_lag(pts: Column, w: int, p: Params, drop_empty: bool | None) -> Column:
    """Array of (t, v): mean squared displacement in square micrometres by lag 1..w; empty lags are 0, left out, or null (None)."""
    scale = (p.px_scale / 1000) ** 2
    pairs = pairs_of(pts, lambda a, b: F.struct((b["frame"] - a["frame"]).alias("lag"), ((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("d")))

    def of(lag: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda q: q["lag"] == lag), lambda q: q["d"])
        value = mean_of(own) * scale
        return F.struct((lag / p.frame_rate).alias("t"), (F.coalesce(value, F.lit(0.0)) if drop_empty is False else value).alias("v"))

    found = F.array(*[of(F.lit(k)) for k in range(1, w + 1)])
    return F.filter(found, lambda q: q["v"].isNotNull() & (q["v"] > 0)) if drop_empty else found


def _displacements(df: DataFrame, lags: int, keys: Sequence[str]) -> DataFrame:
    """df with _q1 .. _q{lags}: the squared displacement, square pixels, from the row of the track that many frames before; null without such a row."""

    def squared(k: int) -> Column:
        at = frames(-k, -k, keys)
        dx, dy = F.col("x_px") - F.first("x_px").over(at), F.col("y_px") - F.first("y_px").over(at)
        return dx * dx + dy * dy

    return df.withColumns({f"_q{k}": squared(k) for k in range(1, lags + 1)})


def _msd(lag: int, low: int, high: int, p: Params, keys: Sequence[str]) -> Column:
    """Mean squared displacement at a lag, square micrometres, between rows of frames low..high around a row, from _displacements(); null for an empty lag.

    Two rows of the window are a lag apart if the later one is at least that far behind the window's start, so each lag is a frame range too.
    """
    if low + lag > high:
        return F.lit(None).cast("double")
    return F.avg(f"_q{lag}").over(frames(low + lag, high, keys)) * (p.px_scale / 1000) ** 2


def _added(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _slope_of(tv: Sequence[tuple[Column, Column]], n: Column) -> Column:
    """Least-squares slope of n points (t, v), of which those not given are (0, 0)."""
    sx, sy, sxy, sxx = _added([t for t, _ in tv]), _added([v for _, v in tv]), _added([t * v for t, v in tv]), _added([t * t for t, _ in tv])
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def _without(df: DataFrame, lags: int, *more: str) -> DataFrame:
    return df.drop(*[f"_q{k}" for k in range(1, lags + 1)], *more)


def local_diffusion(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """A quarter of the slope of mean squared displacement against lag in frames +-w; empty lags count as 0."""
    lags = range(1, p.w + 1)
    d = _displacements(df, p.w, keys).withColumns({f"_v{k}": F.coalesce(_msd(k, -p.w, p.w, p, keys), F.lit(0.0)) for k in lags})
    d = d.withColumn("local_d", _slope_of([(F.lit(k / p.frame_rate), F.col(f"_v{k}")) for k in lags], F.lit(float(p.w))) / 4)
    return _without(d, p.w, *[f"_v{k}" for k in lags])


def _guarded(df: DataFrame, low: int, high: int, keys: Sequence[str]) -> Column:
    """Whether the row is number low..n-high of its track."""
    row = F.row_number().over(track(keys))
    return (row >= low) & (row <= F.count("*").over(whole(keys)) - high)


def rolling_diffusion(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ratio and difference of diffusion after and before a row; fits through (0, 0) and the non-empty lags; 0 outside rows 3..n-2."""
    lags = range(1, p.w)  # a side is w frames, so no pair of its rows is further apart
    sides = {"a": (-p.w, -1), "b": (0, p.w - 1)}
    d = _displacements(df, p.w - 1, keys) if lags else df
    d = d.withColumns({f"_{s}{k}": _msd(k, *ends, p, keys) for s, ends in sides.items() for k in lags} | {"_ok": _guarded(df, 3, 2, keys)})

    def fit(s: str) -> Column:
        if not lags:
            return F.lit(None).cast("double")
        there = {k: F.col(f"_{s}{k}") > 0 for k in lags}
        n = _added([F.when(there[k], 1).otherwise(0) for k in lags])
        tv = [(F.when(there[k], k / p.frame_rate).otherwise(0.0), F.when(there[k], F.col(f"_{s}{k}")).otherwise(0.0)) for k in lags]
        return F.when(n == 1, F.try_divide(_added([v for _, v in tv]), _added([t for t, _ in tv])) / 4).when(n > 1, _slope_of(tv, n + 1) / 4)

    d = d.withColumns({f"_d{s}": fit(s) for s in sides})
    both = F.col("_da").isNotNull() & F.col("_db").isNotNull() & F.col("_ok")
    d = d.withColumns({"d_ratio": F.when(both, F.try_divide("_db", "_da")).otherwise(0.0), "d_delta": F.when(both, F.col("_db") - F.col("_da")).otherwise(0.0)})
    return _without(d, p.w - 1, *[f"_{s}{k}" for s in sides for k in lags], "_da", "_db", "_ok")


def anomalous_exponent(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Slope of log mean squared displacement against log lag in frames +-w, over non-empty lags; null with fewer than two."""
    d = df.withColumn("_p", points(frames(-p.w, p.w, keys))).withColumn("_m", _msd_by_lag(F.col("_p"), p.w, p, True))
    logs = F.transform("_m", lambda q: F.struct(F.log(q["t"]).alias("t"), F.log(q["v"]).alias("v")))
    return d.withColumn("_l", logs).withColumn("alpha", F.when(F.size("_l") >= 2, slope(F.col("_l")))).drop("_p", "_m", "_l")


def _sides(df: DataFrame, p: Params, keys: Sequence[str], make: Callable[[Column], Column], least: int, low: int, high: int, name: str) -> DataFrame:
    """Ratio, difference and absolute difference (nm) of a measure of the steps inside frames 0..w against -w..0.

    Where steps are equal but for rounding, a ratio is one of rounding errors, so steps, latest first, and sums are taken as the SQL takes them, in pixels.
    """
    d = df.withColumns({"_a": points(frames(-p.w, 0, keys)), "_b": points(frames(0, p.w, keys)), "_ok": _guarded(df, low, high, keys)})

    def latest_first(a: Column) -> Column:
        return F.reverse(F.transform(after(a), lambda q, i: F.sqrt((q["x"] - a[i]["x"]) * (q["x"] - a[i]["x"]) + (q["y"] - a[i]["y"]) * (q["y"] - a[i]["y"]))))

    d = d.withColumns({"_sa": latest_first(F.col("_a")), "_sb": latest_first(F.col("_b"))})
    ok = F.col("_ok") & (F.size("_a") >= least) & (F.size("_b") >= least)
    d = d.withColumns({"_va": F.when(ok, make(F.col("_sa"))), "_vb": F.when(ok, make(F.col("_sb")))})
    delta = (F.col("_vb") - F.col("_va")) * p.px_scale
    return d.withColumns({f"{name}_ratio": F.when(ok, F.try_divide("_vb", "_va")).otherwise(0.0), f"{name}_delta": F.when(ok, delta).otherwise(0.0), f"{name}_abs": F.when(ok, F.abs(delta)).otherwise(0.0)}).drop("_a", "_b", "_sa", "_sb", "_va", "_vb", "_ok")


def rolling_step_mean(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return _sides(df, p, keys, mean_of, 2, 2, 1, "step_mean")


def rolling_step_std(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    return _sides(df, p, keys, running_std, 3, 3, 2, "step_std")


def _halves(df: DataFrame, p: Params, keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec, Column]:
    """The frames -w..-1 and 0..w-1 of a row, and whether it is row 3..n-1 of its track with two rows at least in either."""
    a, b = frames(-p.w, -1, keys), frames(0, p.w - 1, keys)
    return a, b, _guarded(df, 3, 1, keys) & (F.count("*").over(a) >= 2) & (F.count("*").over(b) >= 2)


def _changes(d: DataFrame, name: str) -> DataFrame:
    """Ratio, difference and absolute difference of _b against _a where _ok, else 0; a ratio to nothing is null."""
    delta = F.when(F.col("_ok"), F.col("_b") - F.col("_a")).otherwise(0.0)
    return d.withColumns({f"{name}_ratio": F.when(F.col("_ok"), F.try_divide("_b", "_a")).otherwise(0.0), f"{name}_delta": delta, f"{name}_abs": F.abs(delta)}).drop("_a", "_b", "_ok")


def rolling_position_std(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the standard deviations of x and y before and after a row, nm; 0 outside rows 3..n-1, or with fewer than two rows on a side."""
    a, b, ok = _halves(df, p, keys)
    d = df.withColumns({s: (F.stddev_samp("x_px").over(w) + F.stddev_samp("y_px").over(w)) / 2 * p.px_scale for s, w in (("_a", a), ("_b", b))})
    return _changes(d.withColumn("_ok", ok), "pos_std")


def rolling_dispersion(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean distance to the centroid before and after a row, nm; 0 outside rows 3..n-1, or with fewer than two rows on a side."""
    a, b, ok = _halves(df, p, keys)
    d = df.withColumns({"_pa": points(a), "_pb": points(b), "_ok": ok})

    def spread(c: Column) -> Column:
        cx, cy = mean_of(F.transform(c, lambda q: q["x"])), mean_of(F.transform(c, lambda q: q["y"]))
        return mean_of(F.transform(c, lambda q: F.hypot(q["x"] - cx, q["y"] - cy))) * p.px_scale

    return _changes(d.withColumns({"_a": spread(F.col("_pa")), "_b": spread(F.col("_pb"))}), "disp").drop("_pa", "_pb")


def centroid_shift(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance of the centroids before and after a row, nm; 0 outside rows 3..n-1, or with fewer than two rows on a side."""
    a, b, ok = _halves(df, p, keys)
    far = F.hypot(F.avg("x_px").over(b) - F.avg("x_px").over(a), F.avg("y_px").over(b) - F.avg("y_px").over(a))
    return df.withColumn("centroid_nm", F.when(ok, far * p.px_scale).otherwise(0.0))


def _around(df: DataFrame, p: Params, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_p", points(frames(-p.w, p.w, keys))).withColumn("_s", steps_of(F.col("_p"))).withColumn("_net", dist(F.element_at("_p", 1), F.element_at("_p", -1)))


def efficiency(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    squares = total(F.transform("_s", lambda s: s * s))
    return _around(df, p, keys).withColumn("efficiency", F.coalesce(F.try_divide(F.col("_net") * F.col("_net"), F.size("_s") * squares), F.lit(0.0))).drop("_p", "_s", "_net")


def straightness(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Net displacement over path in frames +-w; 0 within w rows of either end."""
    d = _around(df, p, keys).withColumn("_ok", _guarded(df, p.w + 1, p.w, keys))
    return d.withColumn("straightness", F.when(F.col("_ok"), F.coalesce(F.try_divide("_net", total(F.col("_s"))), F.lit(0.0))).otherwise(0.0)).drop("_p", "_s", "_net", "_ok")


def axis_kurtosis(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Kurtosis of positions along the dominant axis of the gyration tensor in frames +-w, with the sample deviation below; 0 without spread."""
    d = df.withColumn("_p", points(frames(-p.w, p.w, keys))).withColumns({"_x": F.transform("_p", lambda q: q["x"]), "_y": F.transform("_p", lambda q: q["y"])})
    d = d.withColumns({"_mx": mean_of(F.col("_x")), "_my": mean_of(F.col("_y"))})
    d = d.withColumns({"_xx": mean_of(F.transform("_p", lambda q: (q["x"] - F.col("_mx")) * (q["x"] - F.col("_mx")))), "_yy": mean_of(F.transform("_p", lambda q: (q["y"] - F.col("_my")) * (q["y"] - F.col("_my")))), "_xy": mean_of(F.transform("_p", lambda q: (q["x"] - F.col("_mx")) * (q["y"] - F.col("_my"))))})
    d = d.withColumn("_t", F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2)
    d = d.withColumn("_u", F.transform("_p", lambda q: (q["x"] - F.col("_mx")) * F.cos("_t") + (q["y"] - F.col("_my")) * F.sin("_t")))
    value = F.try_divide(F.try_divide(central(F.col("_u"), 4), F.size("_u")), F.pow(std_of(F.col("_u")), 4))
    return d.withColumn("axis_kurtosis", F.coalesce(value, F.lit(0.0))).drop("_p", "_x", "_y", "_mx", "_my", "_xx", "_yy", "_xy", "_t", "_u")


def step_kurtosis(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population kurtosis (not excess) of the steps in frames +-w; 0 with fewer than 4."""
    n = F.size("_s")
    value = F.try_divide(central(F.col("_s"), 4) / n, F.pow(central(F.col("_s"), 2) / n, 2))
    return _around(df, p, keys).withColumn("step_kurtosis", F.when(n >= 4, F.coalesce(value, F.lit(0.0))).otherwise(0.0)).drop("_p", "_s", "_net")


def _widest(c: Column) -> Column:
    return F.array_max(pairs_of(c, dist))


def fractal_dimension(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """log N / log(N d / L) with N steps, path L and widest distance d in frames +-w; 0 where undefined."""
    d = _around(df, p, keys).withColumns({"_d": _widest(F.col("_p")), "_l": total(F.col("_s")), "_n": F.size("_s").cast("double")})
    below = F.try_divide(F.col("_n") * F.col("_d"), F.col("_l"))
    return d.withColumn("fractal", F.when(F.col("_n") >= 1, F.coalesce(F.try_divide(F.log("_n"), F.when(below > 0, F.log(below))), F.lit(0.0))).otherwise(0.0)).drop("_p", "_s", "_net", "_d", "_l", "_n")


def trappedness(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS, c1: float = 0.2048, c2: float = 0.25117) -> DataFrame:
    """1 - exp(c1 - c2 D t / r^2) with the frame interval t, half the widest distance r and D from lags 1 and 2 in frames +-w.

    0 with fewer than 3 rows, without spread, or where D is 0, as it is unless both lags occur.
    """
    d = df.withColumn("_p", points(frames(-p.w, p.w, keys))).withColumns({"_m": _msd_by_lag(F.col("_p"), 2, p, None), "_r": _widest(F.col("_p")) / 2 * (p.px_scale / 1000)})
    d = d.withColumn("_d", (F.col("_m")[1]["v"] - F.col("_m")[0]["v"]) / 4 * p.frame_rate)
    inner = c1 - c2 * F.try_divide(F.col("_d") / p.frame_rate, F.col("_r") * F.col("_r"))
    return d.withColumn("trapped", F.when((F.size("_p") >= 3) & (F.col("_r") > 0) & (F.col("_d") != 0), 1 - F.exp(inner)).otherwise(0.0)).drop("_p", "_m", "_r", "_d")


def angle_asymmetry(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """log2((forward + 1) / (backward + 1)) of turn angles up to 30 and from 150 degrees in frames +-w; the first two rows are 0 and don't count."""
    d = df.withColumns({"_turn": turn_angle_of(keys), "_rn": F.row_number().over(track(keys))})
    w = frames(-p.w, p.w, keys)
    forward = F.sum(F.when((F.col("_rn") > 2) & (F.col("_turn") <= 30), 1).otherwise(0)).over(w)
    backward = F.sum(F.when((F.col("_rn") > 2) & (F.col("_turn") >= 150), 1).otherwise(0)).over(w)
    return d.withColumn("asymmetry", F.when(F.col("_rn") > 2, F.log2((forward + 1) / (backward + 1))).otherwise(0.0)).drop("_rn", "_turn")


def velocity_autocorrelation(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean dot product of consecutive displacements in frames +-w, square pixels; 0 with fewer than 3 rows."""
    d = df.withColumn("_p", points(frames(-p.w, p.w, keys)))
    dots = F.transform(after(F.col("_p"), 2), lambda c, i: (c["x"] - F.col("_p")[i + 1]["x"]) * (F.col("_p")[i + 1]["x"] - F.col("_p")[i]["x"]) + (c["y"] - F.col("_p")[i + 1]["y"]) * (F.col("_p")[i + 1]["y"] - F.col("_p")[i]["y"]))
    return d.withColumn("_v", dots).withColumn("velocity_corr", F.coalesce(mean_of(F.col("_v")), F.lit(0.0))).drop("_p", "_v")


def maximal_excursion(df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest step over net displacement in frames +-w; 0 without net displacement."""
    return _around(df, p, keys).withColumn("excursion", F.coalesce(F.try_divide(F.array_max("_s"), F.col("_net")), F.lit(0.0))).drop("_p", "_s", "_net")


def keep_columns(df: DataFrame, chosen: Sequence[str], keys: Sequence[str] = (*KEYS, "frame", "x_px", "y_px")) -> DataFrame:
    """The key columns and the chosen ones; a missing one raises an error."""
    if missing := [c for c in (*keys, *chosen) if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*dict.fromkeys((*keys, *chosen)))


def feature_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, min, max, mean, std (population) in one pass; NaN and null are skipped in sums but counted."""
    n = F.count("*")

    def clean(c: str) -> Column:
        return F.when(F.isnan(c) | F.col(c).isNull(), None).otherwise(F.col(c))

    parts = [F.struct(F.lit(c).alias("feature"), F.min(clean(c)).alias("min"), F.max(clean(c)).alias("max"), F.try_divide(F.sum(clean(c)), n).alias("mean"), F.stddev_pop(clean(c)).alias("std")) for c in names]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


#: The features of a row by name; with_features() adds those asked for.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (positions_nm, step_size, time_step, experiment_time, time_from_start, distance_from_start, distance_travelled, track_position, image_angle, turn_angle, spot_size, spot_area, smoothed_steps, local_diffusion, rolling_diffusion, anomalous_exponent, rolling_step_mean, rolling_step_std, rolling_position_std, rolling_dispersion, centroid_shift, efficiency, straightness, axis_kurtosis, step_kurtosis, fractal_dimension, trappedness, angle_asymmetry, velocity_autocorrelation, maximal_excursion)
}


def with_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the named features and an empty label; all of them share one exchange on the track key."""
    out = reduce(lambda d, n: REGISTRY[n](d), names, df)
    return out if "class_label" in out.columns else out.withColumn("class_label", F.lit(None).cast("int"))
