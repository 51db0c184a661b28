"""Queries of the feature operators (E) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import features as E
from ..params import DEFAULT
from .fixtures import LOCS, locs

PX, RATE, W = DEFAULT.px_scale, DEFAULT.frame_rate, DEFAULT.w
QUERIES, ORACLE = {}, {}

_WINDOWS = f"""
 WINDOW tk AS (PARTITION BY cell_id, mol_id ORDER BY frame),
  run AS (PARTITION BY cell_id, mol_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  al AS (PARTITION BY cell_id, mol_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  l1 AS (PARTITION BY cell_id, mol_id ORDER BY frame RANGE BETWEEN {W} PRECEDING AND 1 PRECEDING),
  r1 AS (PARTITION BY cell_id, mol_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND {W - 1} FOLLOWING),
  cw AS (PARTITION BY cell_id, mol_id ORDER BY frame RANGE BETWEEN {W} PRECEDING AND {W} FOLLOWING)"""

#: Rows with their moves, and row numbers.
_MOVES = f"""m AS (
  SELECT *, x_px - lag(x_px) OVER tk AS dx, y_px - lag(y_px) OVER tk AS dy,
    lag(x_px) OVER tk - lag(x_px, 2) OVER tk AS ex, lag(y_px) OVER tk - lag(y_px, 2) OVER tk AS ey,
    lag(frame) OVER tk AS pf, row_number() OVER tk AS row, count(*) OVER al AS n
  FROM locs {_WINDOWS}),
s AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, coalesce(sqrt(dx * dx + dy * dy), 0) * {PX} AS step_nm FROM m)"""


def _add(key: str, make, columns: list[str], sql: str) -> None:
    def query(spark, sf_dir: str) -> DataFrame:
        return make(locs(spark, sf_dir)).select("cell_id", "mol_id", "frame", *[rounded(F.col(c).cast("double")).alias(c) for c in columns])

    QUERIES[key] = query
    ORACLE[key] = sql


def _lag(key: str, make, expressions: dict[str, str]) -> None:
    chosen = ", ".join(f"round(CAST({x} AS DOUBLE), 4) + 0.0 AS {c}" for c, x in expressions.items())
    _add(key, make, list(expressions), f"WITH {LOCS}, {_MOVES} SELECT cell_id, mol_id, frame, {chosen} FROM s {_WINDOWS}")


_RAD = "CASE WHEN ex = 0 AND ey = 0 THEN atan2(dy + 0.0, dx + 0.0) ELSE atan2(ex * dy - ey * dx + 0.0, ex * dx + ey * dy + 0.0) END"
_TURN = f"abs(degrees({_RAD}))"
_lag("E-02", E.positions_nm, {"x_nm": f"x_px * {PX}", "y_nm": f"y_px * {PX}"})
_lag("E-03", E.step_size, {"step_nm": "step_nm"})
_lag("E-04", E.time_step, {"time_step": f"coalesce((frame - pf) / {RATE}, 0)"})
_lag("E-05", E.experiment_time, {"time": f"frame / {RATE}"})
_lag("E-06", E.time_from_start, {"time_from_start": f"(frame - first_value(frame) OVER tk) / {RATE}"})
_lag("E-07", lambda d: E.time_from_references(d, {"drug": 10.0, "wash": 55.5}), {"time_from_drug": f"frame / {RATE} - 10", "time_from_wash": f"frame / {RATE} - 55.5"})
_lag("E-08", E.distance_from_start, {"from_start_nm": f"sqrt(power(x_px - first_value(x_px) OVER tk, 2) + power(y_px - first_value(y_px) OVER tk, 2)) * {PX}"})
_lag("E-09", E.distance_travelled, {"travelled_nm": "sum(step_nm) OVER run"})
_lag("E-10", E.track_position, {"rows_from_start": "row - 1", "rows_to_end": "n - row", "frames_from_start": "frame - first_value(frame) OVER al", "frames_to_end": "last_value(frame) OVER al - frame"})
_lag("E-11", E.image_angle, {"image_angle": "coalesce(abs(degrees(atan2(dy, dx))), 0)"})
_lag("E-12", E.turn_angle, {"turn_angle": f"coalesce({_TURN}, 0)"})
_lag("E-12b", E.signed_angles, {"image_rad": "atan2(dy, dx)", "turn_rad": _RAD})
_lag("E-12c", E.turn_angle_simple, {"turn_simple": "degrees(acos(greatest(-1, least(1, (ex * dx + ey * dy) / nullif(sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey), 0)))))"})
_lag("E-14", E.spot_size, {"spot_size": f"2 * sqrt(power(sigma_x_px * {PX}, 2) + power(sigma_y_px * {PX}, 2))"})
_lag("E-15", E.spot_area, {"spot_area": f"pi() * sigma_x_px * sigma_y_px * {PX * PX}"})
_lag("E-16", lambda d: E.shifted_steps(d, 2, 2), {f"step_{'m' if k < 0 else 'p'}{abs(k)}": f"{'lag' if k < 0 else 'lead'}(step_nm, {abs(k)}, 0) OVER tk" for k in (-1, -2, 1, 2)})
#: Two rows at least on either side of rows 3..n-1.
_OK = "row BETWEEN 3 AND n - 1 AND count(*) OVER l1 >= 2 AND count(*) OVER r1 >= 2"
_SB, _SA = (f"(stddev_samp(x_px) OVER {w} + stddev_samp(y_px) OVER {w}) / 2 * {PX}" for w in ("r1", "l1"))
_lag("E-23", E.rolling_position_std, {
    "pos_std_ratio": f"CASE WHEN {_OK} THEN ({_SB}) / nullif({_SA}, 0) ELSE 0 END",
    "pos_std_delta": f"CASE WHEN {_OK} THEN ({_SB}) - ({_SA}) ELSE 0 END",
    "pos_std_abs": f"CASE WHEN {_OK} THEN abs(({_SB}) - ({_SA})) ELSE 0 END",
})
_lag("E-25", E.centroid_shift, {"centroid_nm": f"CASE WHEN {_OK} THEN sqrt(power(avg(x_px) OVER r1 - avg(x_px) OVER l1, 2) + power(avg(y_px) OVER r1 - avg(y_px) OVER l1, 2)) * {PX} ELSE 0 END"})
_lag("E-32", E.angle_asymmetry, {"asymmetry": f"CASE WHEN row > 2 THEN log2((sum(CASE WHEN row > 2 AND coalesce({_TURN}, 0) <= 30 THEN 1 ELSE 0 END) OVER cw + 1) / (sum(CASE WHEN row > 2 AND coalesce({_TURN}, 0) >= 150 THEN 1 ELSE 0 END) OVER cw + 1)) ELSE 0 END"})



def _cell_angle(d: DataFrame) -> DataFrame:
    axes = d.select("cell_id").distinct().withColumns({"ax": 40.0 + F.col("cell_id"), "ay": F.col("cell_id") * 3.0})
    return E.cell_axis_angle(d, axes)


_A = "degrees(atan2(abs((40.0 + cell_id) * dy - (cell_id * 3.0) * dx), (40.0 + cell_id) * dx + (cell_id * 3.0) * dy))"
for _k in ("E-13", "E-13b"):
    _lag(_k, _cell_angle, {"cell_angle": f"coalesce(CASE WHEN {_A} > 90 THEN 180 - {_A} ELSE {_A} END, 0)"})

_rows = "CASE WHEN row = 1 THEN 0 ELSE {f}(CASE WHEN row > 1 THEN step_nm END) OVER (PARTITION BY cell_id, mol_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND {after} FOLLOWING) END"
_lag("E-17", E.smoothed_steps, {"smoothed_nm": _rows.format(f="avg", after=2)})
_lag("E-17-movmedian", lambda d: E.smoothed_steps(d, "movmedian"), {"smoothed_nm": _rows.format(f="median", after=2)})
_lag("E-17-even", lambda d: E.smoothed_steps(d, width=4), {"smoothed_nm": _rows.format(f="avg", after=1)})
_lag("E-17-movmedian-even", lambda d: E.smoothed_steps(d, "movmedian", 4), {"smoothed_nm": _rows.format(f="median", after=1)})
_add("E-17-gaussian", lambda d: E.smoothed_steps(d, "gaussian"), ["smoothed_nm"], f"""WITH {LOCS}, {_MOVES}
SELECT a.cell_id, a.mol_id, a.frame, round(CASE WHEN a.row = 1 THEN 0 ELSE sum(CASE WHEN b.row > 1 THEN exp(-power(b.row - a.row, 2) / 2) * b.step_nm END) / sum(CASE WHEN b.row > 1 THEN exp(-power(b.row - a.row, 2) / 2) END) END, 4) + 0.0 AS smoothed_nm
FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.mol_id = b.mol_id AND b.row BETWEEN a.row - 2 AND a.row + 2 GROUP BY a.cell_id, a.mol_id, a.frame, a.row""")  # fmt: skip

def _local(method: str, after: int = 2) -> str:
    """Weighted fits over the steps of the rows around, at distance 0: sums of weights and distances, then a line or a parabola by determinants."""
    weight = "1.0" if method == "sgolay" else "power(1 - power(abs(d) / (reach + 1), 3), 3)"
    line = "(s2 * t0 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0)"
    parabola = "(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0)"
    sums = ", ".join(f"sum(w * power(d, {k})) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(w * power(d, {k}) * y) AS t{k}" for k in range(3))
    value = f"CASE WHEN k < 2 THEN t0 / s0 ELSE {line} END" if method == "lowess" else f"CASE WHEN k < 2 THEN t0 / s0 WHEN k < 3 THEN {line} ELSE {parabola} END"
    return f"""WITH {LOCS}, {_MOVES}, nr AS (SELECT a.cell_id, a.mol_id, a.frame, a.row, CAST(b.row - a.row AS DOUBLE) AS d, b.step_nm AS y FROM s a LEFT JOIN s b ON a.cell_id = b.cell_id AND a.mol_id = b.mol_id AND b.row BETWEEN a.row - 2 AND a.row + {after} AND b.row > 1),
wt AS (SELECT *, {weight} AS w FROM (SELECT *, max(abs(d)) OVER (PARTITION BY cell_id, mol_id, frame) AS reach FROM nr)), sm AS (SELECT cell_id, mol_id, frame, row, count(d) AS k, {sums} FROM wt GROUP BY cell_id, mol_id, frame, row)
SELECT cell_id, mol_id, frame, round(CASE WHEN row = 1 THEN 0 ELSE {value} END, 4) + 0.0 AS smoothed_nm FROM sm"""


for _m in ("lowess", "loess", "rlowess", "rloess", "sgolay"):
    QUERIES[f"E-17-{_m}"] = lambda spark, sf_dir, m=_m: E.smoothed_steps(locs(spark, sf_dir), m).select("cell_id", "mol_id", "frame", rounded(F.col("smoothed_nm")).alias("smoothed_nm"))
    if _m[0] != "r":  # the robust ones are held against plain fits in the tests
        ORACLE[f"E-17-{_m}"] = _local(_m)
for _m in ("lowess", "loess"):
    QUERIES[f"E-17-{_m}-even"] = lambda spark, sf_dir, m=_m: E.smoothed_steps(locs(spark, sf_dir), m, 4).select("cell_id", "mol_id", "frame", rounded(F.col("smoothed_nm")).alias("smoothed_nm"))
    ORACLE[f"E-17-{_m}-even"] = _local(_m, 1)

# Windows by self-join: the rows b (and steps that lie inside) of the frames around a.
_JOIN = "FROM s a LEFT JOIN s b ON a.cell_id = b.cell_id AND a.mol_id = b.mol_id AND b.frame BETWEEN a.frame {lo} AND a.frame {hi}"
_GROUP = "GROUP BY a.cell_id, a.mol_id, a.frame, a.row, a.n"
_C = dict(lo=f"- {W}", hi=f"+ {W}")


def _inside(agg: str, lo: str, alias: str = "b") -> str:
    return f"{agg} FILTER (WHERE {alias}.pf >= a.frame {lo})"


def _window(key: str, make, expressions: dict[str, str], lo: str = f"- {W}", hi: str = f"+ {W}", more: str = "") -> None:
    chosen = ", ".join(f"round(CAST({x} AS DOUBLE), 4) + 0.0 AS {c}" for c, x in expressions.items())
    _add(key, make, list(expressions), f"WITH {LOCS}, {_MOVES}{more} SELECT a.cell_id, a.mol_id, a.frame, {chosen} {_JOIN.format(lo=lo, hi=hi)} {_GROUP}")


_first, _last = "arg_min(b.x_px, b.frame)", "arg_max(b.x_px, b.frame)"
_net2 = "(power(arg_max(b.x_px, b.frame) - arg_min(b.x_px, b.frame), 2) + power(arg_max(b.y_px, b.frame) - arg_min(b.y_px, b.frame), 2))"
_in = f"- {W}"
_window("E-26", E.efficiency, {"efficiency": f"coalesce({_net2} / nullif({_inside('count(b.step)', _in)} * {_inside('sum(b.step * b.step)', _in)}, 0), 0)"})
_window("E-27", E.straightness, {"straightness": f"CASE WHEN a.row BETWEEN {W + 1} AND a.n - {W} THEN coalesce(sqrt({_net2}) / nullif({_inside('sum(b.step)', _in)}, 0), 0) ELSE 0 END"})
_window("E-29", E.step_kurtosis, {"step_kurtosis": f"CASE WHEN {_inside('count(b.step)', _in)} >= 4 THEN coalesce({_inside('kurtosis_pop(b.step)', _in)} + 3, 0) ELSE 0 END"})
_window("E-34", E.maximal_excursion, {"excursion": f"coalesce({_inside('max(b.step)', _in)} / nullif(sqrt({_net2}), 0), 0)"})
_window("E-33", E.velocity_autocorrelation, {"velocity_corr": "coalesce(avg(b.dx * b.ex + b.dy * b.ey) FILTER (WHERE b.ppf >= a.frame - 5), 0)"}, more="")
ORACLE["E-33"] = ORACLE["E-33"].replace("SELECT *, sqrt(dx * dx + dy * dy) AS step,", "SELECT *, lag(pf) OVER (PARTITION BY cell_id, mol_id ORDER BY frame) AS ppf, sqrt(dx * dx + dy * dy) AS step,")


def _two_sides(key: str, make, name: str, value: str, least: int, low: int, high: int) -> None:
    """value over the steps inside frames -w..0 and 0..w."""
    left, right = value.replace("@", f"b.frame <= a.frame AND b.pf >= a.frame - {W}"), value.replace("@", "b.frame >= a.frame AND b.pf >= a.frame")
    ok = f"a.row BETWEEN {low} AND a.n - {high} AND count(*) FILTER (WHERE b.frame <= a.frame) >= {least} AND count(*) FILTER (WHERE b.frame >= a.frame) >= {least}"
    _window(key, make, {f"{name}_ratio": f"CASE WHEN {ok} THEN {right} / nullif({left}, 0) ELSE 0 END", f"{name}_delta": f"CASE WHEN {ok} THEN ({right} - {left}) * {PX} ELSE 0 END", f"{name}_abs": f"CASE WHEN {ok} THEN abs({right} - {left}) * {PX} ELSE 0 END"})


_two_sides("E-21", E.rolling_step_mean, "step_mean", "avg(b.step) FILTER (WHERE @)", 2, 2, 1)
_two_sides("E-22", E.rolling_step_std, "step_std", "stddev_samp(b.step) FILTER (WHERE @)", 3, 3, 2)

_LR = f"l.cell_id = a.cell_id AND l.mol_id = a.mol_id AND l.frame BETWEEN a.frame {{lo}} AND a.frame {{hi}}"


def _cent(name: str, lo: str, hi: str) -> str:
    return f"""{name}c AS (SELECT a.cell_id, a.mol_id, a.frame, avg(l.x_px) AS cx, avg(l.y_px) AS cy FROM s a JOIN s l ON {_LR.format(lo=lo, hi=hi)} GROUP BY ALL),
{name} AS (SELECT a.cell_id, a.mol_id, a.frame, avg(sqrt(power(l.x_px - cx, 2) + power(l.y_px - cy, 2))) * {PX} AS v, count(*) AS k FROM {name}c a JOIN s l ON {_LR.format(lo=lo, hi=hi)} GROUP BY ALL)"""


_both = "row BETWEEN 3 AND n - 1 AND lf.k >= 2 AND rt.k >= 2"
_add("E-24", E.rolling_dispersion, ["disp_ratio", "disp_delta", "disp_abs"], f"""WITH {LOCS}, {_MOVES}, {_cent('lf', f'- {W}', '- 1')}, {_cent('rt', '+ 0', f'+ {W - 1}')}
SELECT a.cell_id, a.mol_id, a.frame, round(CASE WHEN {_both} THEN rt.v / nullif(lf.v, 0) ELSE 0 END, 4) + 0.0 AS disp_ratio,
  round(CASE WHEN {_both} THEN rt.v - lf.v ELSE 0 END, 4) + 0.0 AS disp_delta, round(CASE WHEN {_both} THEN abs(rt.v - lf.v) ELSE 0 END, 4) + 0.0 AS disp_abs
FROM s a LEFT JOIN lf USING (cell_id, mol_id, frame) LEFT JOIN rt USING (cell_id, mol_id, frame)""")  # fmt: skip

_add("E-28", E.axis_kurtosis, ["axis_kurtosis"], f"""WITH {LOCS}, {_MOVES},
g AS (SELECT a.cell_id, a.mol_id, a.frame, avg(b.x_px) AS mx, avg(b.y_px) AS my, atan2(2 * covar_pop(b.x_px, b.y_px), var_pop(b.x_px) - var_pop(b.y_px)) / 2 AS t {_JOIN.format(**_C)} GROUP BY a.cell_id, a.mol_id, a.frame),
u AS (SELECT g.cell_id, g.mol_id, g.frame, (b.x_px - mx) * cos(t) + (b.y_px - my) * sin(t) AS u FROM g JOIN s b ON g.cell_id = b.cell_id AND g.mol_id = b.mol_id AND b.frame BETWEEN g.frame - {W} AND g.frame + {W})
SELECT cell_id, mol_id, frame, round(coalesce(avg(power(u - mu, 4)) / nullif(power(var_samp(u), 2), 0), 0), 4) + 0.0 AS axis_kurtosis
FROM (SELECT *, avg(u) OVER (PARTITION BY cell_id, mol_id, frame) AS mu FROM u) GROUP BY cell_id, mol_id, frame""")  # fmt: skip

#: Pairs of points in frames +-w of a row, and the widest.
_PAIR = f"""wide AS (SELECT a.cell_id, a.mol_id, a.frame, max(sqrt(power(q.x_px - p.x_px, 2) + power(q.y_px - p.y_px, 2))) AS d
 FROM s a JOIN s p ON p.cell_id = a.cell_id AND p.mol_id = a.mol_id AND p.frame BETWEEN a.frame - {W} AND a.frame + {W}
 JOIN s q ON q.cell_id = a.cell_id AND q.mol_id = a.mol_id AND q.frame BETWEEN p.frame + 1 AND a.frame + {W} GROUP BY a.cell_id, a.mol_id, a.frame)"""
_add("E-30", E.fractal_dimension, ["fractal"], f"""WITH {LOCS}, {_MOVES}, {_PAIR},
l AS (SELECT a.cell_id, a.mol_id, a.frame, {_inside('count(b.step)', _in)} AS k, {_inside('sum(b.step)', _in)} AS len {_JOIN.format(**_C)} GROUP BY a.cell_id, a.mol_id, a.frame)
SELECT l.cell_id, l.mol_id, l.frame, round(CASE WHEN k >= 1 THEN coalesce(ln(k) / nullif(CASE WHEN k * d / nullif(len, 0) > 0 THEN ln(k * d / nullif(len, 0)) END, 0), 0) ELSE 0 END, 4) + 0.0 AS fractal
FROM l LEFT JOIN wide USING (cell_id, mol_id, frame)""")  # fmt: skip


def _lags(name: str, lo: str, hi: str, most: int) -> str:
    """Mean squared displacement by lag of the points in a window."""
    return f"""{name} AS (SELECT a.cell_id, a.mol_id, a.frame, q.frame - p.frame AS lag, avg(power(q.x_px - p.x_px, 2) + power(q.y_px - p.y_px, 2)) * {(PX / 1000) ** 2} AS v
 FROM s a JOIN s p ON p.cell_id = a.cell_id AND p.mol_id = a.mol_id AND p.frame BETWEEN a.frame {lo} AND a.frame {hi}
 JOIN s q ON q.cell_id = a.cell_id AND q.mol_id = a.mol_id AND q.frame BETWEEN p.frame + 1 AND least(p.frame + {most}, a.frame {hi}) GROUP BY ALL)"""


def _grid(most: int) -> str:
    return f"grid AS (SELECT cell_id, mol_id, frame, CAST(k AS INT) AS lag FROM s CROSS JOIN range(1, {most + 1}) t(k))"


_add("E-18", E.local_diffusion, ["local_d"], f"""WITH {LOCS}, {_MOVES}, {_lags('ms', f'- {W}', f'+ {W}', W)}, {_grid(W)}
SELECT cell_id, mol_id, frame, round(regr_slope(coalesce(v, 0), lag / {RATE}) / 4, 4) + 0.0 AS local_d FROM grid LEFT JOIN ms USING (cell_id, mol_id, frame, lag) GROUP BY cell_id, mol_id, frame""")  # fmt: skip
_add("E-20", E.anomalous_exponent, ["alpha"], f"""WITH {LOCS}, {_MOVES}, {_lags('ms', f'- {W}', f'+ {W}', W)}
SELECT s.cell_id, s.mol_id, s.frame, round(CASE WHEN count(v) FILTER (WHERE v > 0) >= 2 THEN regr_slope(ln(CASE WHEN v > 0 THEN v END), ln(lag / {RATE})) END, 4) + 0.0 AS alpha
FROM s LEFT JOIN ms USING (cell_id, mol_id, frame) GROUP BY s.cell_id, s.mol_id, s.frame""")  # fmt: skip


def _fit(name: str, of: str) -> str:
    return f"""{name} AS (SELECT cell_id, mol_id, frame, CASE WHEN count(*) = 1 THEN max(v / (lag / {RATE})) / 4
  ELSE ((count(*) + 1) * sum(v * lag / {RATE}) - sum(v) * sum(lag / {RATE})) / ((count(*) + 1) * sum(power(lag / {RATE}, 2)) - power(sum(lag / {RATE}), 2)) / 4 END AS d FROM {of} WHERE v > 0 GROUP BY cell_id, mol_id, frame)"""


_add("E-19", E.rolling_diffusion, ["d_ratio", "d_delta"], f"""WITH {LOCS}, {_MOVES}, {_lags('ml', f'- {W}', '- 1', W)}, {_lags('mr', '+ 0', f'+ {W - 1}', W)}, {_fit('fl', 'ml')}, {_fit('fr', 'mr')}
SELECT s.cell_id, s.mol_id, s.frame, round(CASE WHEN fl.d IS NOT NULL AND fr.d IS NOT NULL AND row BETWEEN 3 AND n - 2 THEN fr.d / nullif(fl.d, 0) ELSE 0 END, 4) + 0.0 AS d_ratio,
  round(CASE WHEN fl.d IS NOT NULL AND fr.d IS NOT NULL AND row BETWEEN 3 AND n - 2 THEN fr.d - fl.d ELSE 0 END, 4) + 0.0 AS d_delta
FROM s LEFT JOIN fl USING (cell_id, mol_id, frame) LEFT JOIN fr USING (cell_id, mol_id, frame)""")  # fmt: skip
_add("E-31", E.trappedness, ["trapped"], f"""WITH {LOCS}, {_MOVES}, {_PAIR}, {_lags('ms', f'- {W}', f'+ {W}', 2)},
f AS (SELECT cell_id, mol_id, frame, (max(v) FILTER (WHERE lag = 2) - max(v) FILTER (WHERE lag = 1)) / (4 / {RATE}) AS dif FROM ms GROUP BY cell_id, mol_id, frame),
t AS (SELECT a.cell_id, a.mol_id, a.frame, count(*) AS k {_JOIN.format(**_C)} GROUP BY a.cell_id, a.mol_id, a.frame)
SELECT t.cell_id, t.mol_id, t.frame, round(CASE WHEN k >= 3 AND d > 0 AND dif <> 0 THEN 1 - exp(0.2048 - 0.25117 * (dif * (1 / {RATE}) / power(d / 2 * {PX / 1000}, 2))) ELSE 0 END, 4) + 0.0 AS trapped
FROM t LEFT JOIN f USING (cell_id, mol_id, frame) LEFT JOIN wide USING (cell_id, mol_id, frame)""")  # fmt: skip

QUERIES["E-01"] = lambda spark, sf_dir: E.with_features(locs(spark, sf_dir), ["positions_nm", "step_size", "time_step", "turn_angle"]).select("cell_id", "mol_id", "frame", *[rounded(F.col(c)).alias(c) for c in ("x_nm", "y_nm", "step_nm", "time_step", "turn_angle")], "class_label")
ORACLE["E-01"] = f"WITH {LOCS}, {_MOVES} SELECT cell_id, mol_id, frame, round(x_px * {PX}, 4) + 0.0 AS x_nm, round(y_px * {PX}, 4) + 0.0 AS y_nm, round(step_nm, 4) + 0.0 AS step_nm, round(coalesce((frame - pf) / {RATE}, 0), 4) + 0.0 AS time_step, round(coalesce({_TURN}, 0), 4) + 0.0 AS turn_angle, class_label FROM s"
QUERIES["E-40"] = lambda spark, sf_dir: E.keep_columns(locs(spark, sf_dir), ["photons"])
ORACLE["E-40"] = f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px, y_px, photons FROM locs"
QUERIES["E-41"] = lambda spark, sf_dir: E.feature_stats(E.step_size(locs(spark, sf_dir)), ["photons", "step_nm"]).select("feature", *[rounded(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")])
ORACLE["E-41"] = f"""WITH {LOCS}, {_MOVES} SELECT 'photons' AS feature, round(min(photons), 4) + 0.0 AS min, round(max(photons), 4) + 0.0 AS max, round(avg(photons), 4) + 0.0 AS mean, round(stddev_pop(photons), 4) + 0.0 AS std FROM s
UNION ALL SELECT 'step_nm', round(min(step_nm), 4) + 0.0, round(max(step_nm), 4) + 0.0, round(avg(step_nm), 4) + 0.0, round(stddev_pop(step_nm), 4) + 0.0 FROM s"""
