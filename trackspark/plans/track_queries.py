"""Queries of preparation (F) and diffusion (M), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import features as E
from ..operators import msd as M
from ..operators import prepare as P
from ..params import DEFAULT
from .fixtures import LOCS, MESH, PAIRS, cells, locs, paired

PX, RATE, LAG = DEFAULT.px_scale, DEFAULT.frame_rate, DEFAULT.max_lag
SCALE = (PX / 1000) ** 2
LEAST, BUFFER = DEFAULT.min_track_len, DEFAULT.track_buffer
KEY = ["cell_id", "mol_id", "frame"]
QUERIES, ORACLE = {}, {}
#: Added before rounding, because positions are multiples of 1/4000 and sums in another order would round ties apart.
OFF_TIES = 3.1e-9


def _add(key: str, query, sql: str | None = None) -> None:
    QUERIES[key] = query
    if sql:
        ORACLE[key] = sql


_XY = [*KEY, "x_px"]
_RENUMBER = "SELECT p.cell_id, CAST(r.new_id AS BIGINT) AS mol_id, p.frame, p.x_px FROM {0} p JOIN (SELECT cell_id, mol_id, row_number() OVER (PARTITION BY cell_id ORDER BY min(frame), mol_id) AS new_id FROM {0} GROUP BY cell_id, mol_id) r USING (cell_id, mol_id)"
_add("F-02", lambda s, d: P.renumber(paired(s, d)).select(_XY), f"WITH {PAIRS} {_RENUMBER.format('pairs')}")
_add("F-03", lambda s, d: P.drop_short(locs(s, d), 60).select(_XY), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px FROM locs QUALIFY count(*) OVER (PARTITION BY cell_id, mol_id) >= 60")
_SPANS = "spans AS (SELECT cell_id, mol_id, min(frame) AS lo, max(frame) AS hi, count(*) AS n FROM {0} GROUP BY cell_id, mol_id)"
_add("F-04", lambda s, d: P.eliminate_conflicts(paired(s, d), BUFFER, LEAST).select(_XY), f"""WITH {PAIRS}, {_SPANS.format('pairs')},
bad AS (SELECT DISTINCT a.cell_id, a.mol_id FROM spans a JOIN spans b ON a.cell_id = b.cell_id AND a.mol_id <> b.mol_id
  AND ((a.lo > b.lo - {BUFFER} AND a.lo < b.hi + {BUFFER}) OR (a.hi > b.lo - {BUFFER} AND a.hi < b.hi + {BUFFER})))
SELECT cell_id, mol_id, frame, x_px FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.cell_id = p.cell_id AND b.mol_id = p.mol_id)
QUALIFY count(*) OVER (PARTITION BY cell_id, mol_id) >= {LEAST}""")  # fmt: skip
_CUT = f"""{PAIRS}, {_SPANS.format('pairs')},
cut AS (SELECT p.cell_id, p.mol_id, p.frame, p.x_px FROM pairs p JOIN spans s ON s.cell_id = p.cell_id AND p.frame BETWEEN s.lo AND s.hi GROUP BY ALL HAVING count(*) < 2)"""


def _split(source: str, mem: int) -> str:
    return f"""g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY cell_id, mol_id ORDER BY frame) > {mem + 1} THEN 1 ELSE 0 END AS j FROM {source}),
g2 AS (SELECT *, sum(j) OVER (PARTITION BY cell_id, mol_id ORDER BY frame) AS piece FROM g),
g3 AS (SELECT cell_id, mol_id, piece, row_number() OVER (PARTITION BY cell_id ORDER BY mol_id, piece) AS r FROM (SELECT DISTINCT cell_id, mol_id, piece FROM g2 WHERE piece > 0)),
pieces AS (SELECT g2.cell_id, CAST(coalesce(t.top + g3.r, g2.mol_id) AS BIGINT) AS mol_id, g2.frame, g2.x_px FROM g2 LEFT JOIN g3 USING (cell_id, mol_id, piece) JOIN (SELECT cell_id, max(mol_id) AS top FROM {source} GROUP BY cell_id) t ON t.cell_id = g2.cell_id)"""


_add("F-05", lambda s, d: P.truncation_filter(paired(s, d).select(*KEY, "x_px", "y_px"), DEFAULT.mem_param, LEAST).select(_XY),
     f"WITH {_CUT}, {_split('cut', DEFAULT.mem_param)}, long AS (SELECT * FROM pieces QUALIFY count(*) OVER (PARTITION BY cell_id, mol_id) >= {LEAST}) {_RENUMBER.format('long')}")
_add("F-06", lambda s, d: P.split_gaps(locs(s, d), 0).select(_XY), f"WITH {LOCS}, {_split('locs', 0)} SELECT * FROM pieces")
_add("F-07", lambda s, d: P.foreign_points(paired(s, d), paired(s, d), 20).select(_XY), f"""WITH {PAIRS}, {_SPANS.format('pairs')},
ok AS (SELECT s.cell_id, s.mol_id FROM spans s JOIN pairs p ON p.cell_id = s.cell_id AND p.frame BETWEEN s.lo AND s.hi GROUP BY s.cell_id, s.mol_id HAVING count(*) FILTER (WHERE p.mol_id <> s.mol_id) <= 20)
SELECT p.cell_id, p.mol_id, p.frame, p.x_px FROM pairs p JOIN ok USING (cell_id, mol_id)""")  # fmt: skip
_add("F-08", lambda s, d: P.cells_with_tracks(cells(s, d), locs(s, d).where("cell_id NOT IN (2, 5)")).select("cell_id"), f"WITH {LOCS} SELECT DISTINCT cell_id FROM locs WHERE cell_id NOT IN (2, 5)")
_add("F-09", lambda s, d: P.crop(locs(s, d), *P.excluded_rows(["turn_angle", "step_p1"])).select(_XY), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px FROM locs QUALIFY row_number() OVER (PARTITION BY cell_id, mol_id ORDER BY frame) > 2 AND row_number() OVER (PARTITION BY cell_id, mol_id ORDER BY frame DESC) > 1")


def unlabelled(s, d):
    return locs(s, d).withColumn("class_label", F.when(F.col("mol_id") % 10 == 0, -1).otherwise(F.col("class_label")))


UNLABELLED = f"{LOCS}, unl AS (SELECT * REPLACE (CASE WHEN mol_id % 10 = 0 THEN -1 ELSE class_label END AS class_label) FROM locs)"
TRUTH = f"{LOCS}, truth AS (SELECT cell_id, mol_id, frame, class_label FROM locs WHERE (frame + mol_id) % 23 <> 0)"


def truth(s, d):
    return locs(s, d).where((F.col("frame") + F.col("mol_id")) % 23 != 0).select(*KEY, "class_label")


_add("F-11", lambda s, d: P.fully_labelled(unlabelled(s, d)).select(*_XY, "class_label"), f"WITH {UNLABELLED} SELECT cell_id, mol_id, frame, x_px, class_label FROM unl WHERE mol_id % 10 <> 0")
_add("F-12", lambda s, d: P.with_truth_only(locs(s, d), truth(s, d), LEAST).select(_XY), f"WITH {TRUTH} SELECT l.cell_id, l.mol_id, l.frame, l.x_px FROM locs l JOIN truth t USING (cell_id, mol_id, frame) QUALIFY count(*) OVER (PARTITION BY l.cell_id, l.mol_id) >= {LEAST}")
_add("F-13", lambda s, d: P.cells_by_length(locs(s, d), cells(s, d).withColumn("length_px", F.col("length_px") + F.col("cell_id")), 3.9, 4.2, PX).select(_XY), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px FROM locs WHERE (41 + cell_id) * {PX} / 1000 BETWEEN 3.9 AND 4.2")
_add("F-15", lambda s, d: P.annotated_tracks(locs(s, d), unlabelled(s, d)).select(_XY), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px FROM locs WHERE mol_id % 10 <> 0")
_add("F-16", lambda s, d: P.without_zeros(E.step_size(locs(s, d)), ["step_nm", "photons"]).select(_XY), f"WITH {LOCS}, z AS (SELECT *, lag(x_px) OVER w AS px, lag(y_px) OVER w AS py FROM locs WINDOW w AS (PARTITION BY cell_id, mol_id ORDER BY frame)) SELECT cell_id, mol_id, frame, x_px FROM z WHERE px IS NOT NULL AND NOT (px = x_px AND py = y_px) AND photons <> 0")
_add("F-17", lambda s, d: P.with_coordinates(locs(s, d).withColumn("x_px", F.when(F.col("frame") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x_px")))).select(_XY), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px FROM locs WHERE frame % 5 <> 0")

_D2 = "power(b.x_px - a.x_px, 2) + power(b.y_px - a.y_px, 2)"


def _pairs(by: str, source: str, most: int | None) -> str:
    on = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    cols = ", ".join(f"a.{c}" for c in by.split(", "))
    bound = f" AND b.frame <= a.frame + {most}" if most else ""
    return f"SELECT {cols}, b.frame - a.frame AS lag, sum({_D2}) AS sum_sq, count(*) AS n FROM {source} a JOIN {source} b ON {on} AND b.frame > a.frame{bound} GROUP BY ALL"


def _msd_columns(df):
    return df.select("cell_id", "mol_id", "lag", rounded(F.col("sum_sq") + OFF_TIES).alias("sum_sq"), "n", rounded(F.col("t")).alias("t"), rounded(F.col("msd") + OFF_TIES).alias("msd"))


_MSD = f"SELECT cell_id, mol_id, lag, round(sum_sq + {OFF_TIES}, 4) + 0.0 AS sum_sq, n, round(lag / {RATE}, 4) + 0.0 AS t, round(sum_sq / n + {OFF_TIES}, 4) + 0.0 AS msd FROM"
_add("M-01", lambda s, d: _msd_columns(M.msd(locs(s, d))), f"WITH {LOCS} {_MSD} ({_pairs('cell_id, mol_id', 'locs', None)})")
_add("M-02", lambda s, d: _msd_columns(M.msd(locs(s, d), LAG)), f"WITH {LOCS} {_MSD} ({_pairs('cell_id, mol_id', 'locs', LAG)})")
_add("M-03", lambda s, d: M.to_um(locs(s, d)).select(*KEY, *[rounded(F.col(c), 6).alias(c) for c in ("x_um", "y_um")]), f"WITH {LOCS} SELECT cell_id, mol_id, frame, round(x_px * {PX} / 1000, 6) + 0.0 AS x_um, round(y_px * {PX} / 1000, 6) + 0.0 AS y_um FROM locs")
RUNS = """ch AS (SELECT *, CASE WHEN lag(class_label) OVER (PARTITION BY cell_id, mol_id ORDER BY frame) <> class_label THEN 1 ELSE 0 END AS ch FROM {0}),
runs AS (SELECT * EXCLUDE (ch), CAST(sum(ch) OVER (PARTITION BY cell_id, mol_id ORDER BY frame) AS BIGINT) AS run FROM ch)"""
_UNITS = f"""u0 AS ({_pairs('cell_id, mol_id', 'locs', LAG)}), u1 AS ({_pairs('cell_id, mol_id, class_label, run', 'runs', LAG)}),
units AS (SELECT 0 AS grp, lag, sum_sq, n FROM u0 UNION ALL SELECT class_label, lag, sum_sq, n FROM u1)"""
_add("M-04", lambda s, d: M.runs(locs(s, d)).select(*KEY, "class_label", "run"), f"WITH {LOCS}, {RUNS.format('locs')} SELECT cell_id, mol_id, frame, class_label, run FROM runs")
_add("M-05", lambda s, d: M.group_msd(locs(s, d), LAG).select("group", "lag", "n", rounded(F.col("t")).alias("t"), rounded(F.col("msd"), 6).alias("msd")), f"""WITH {LOCS}, {RUNS.format('locs')}, {_UNITS}
SELECT CAST(grp AS INT) AS "group", lag, CAST(sum(n) AS BIGINT) AS n, round(lag / {RATE}, 4) + 0.0 AS t, round(sum(sum_sq) / sum(n) * {SCALE}, 6) + 0.0 AS msd FROM units GROUP BY grp, lag""")  # fmt: skip
_add("M-06", lambda s, d: M.longest_span(locs(s, d)), f"WITH {LOCS} SELECT max(s) AS longest FROM (SELECT max(frame) - min(frame) + 1 AS s FROM locs GROUP BY cell_id, mol_id)")
_add("M-07", lambda s, d: M.runs_by_class(locs(s, d)), f"WITH {LOCS}, {RUNS.format('locs')} SELECT class_label, CAST(count(*) AS BIGINT) AS runs FROM (SELECT DISTINCT cell_id, mol_id, class_label, run FROM runs) GROUP BY class_label")
_add("M-08", lambda s, d: M.equal_weight_msd(locs(s, d), LAG).select("group", "lag", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("sem"), 6).alias("sem"), "units"), f"""WITH {LOCS}, {RUNS.format('locs')}, {_UNITS}
SELECT CAST(grp AS INT) AS "group", lag, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS sem, count(v) AS units FROM (SELECT grp, lag, nullif(sum_sq / n * {SCALE}, 0) AS v FROM units) GROUP BY grp, lag""")  # fmt: skip
_add("M-09", lambda s, d: M.trimmed_group_curve(locs(s, d), LAG).select("group", "lag", rounded(F.col("mean"), 6).alias("mean")), f"""WITH {LOCS}, {RUNS.format('locs')}, {_UNITS},
curve AS (SELECT grp, lag, avg(nullif(sum_sq / n, 0)) * {SCALE} AS mean FROM units GROUP BY grp, lag)
SELECT CAST(grp AS INT) AS "group", lag, round(mean, 6) + 0.0 AS mean FROM curve QUALIFY lag <= max(CASE WHEN mean IS NOT NULL THEN lag END) OVER (PARTITION BY grp)""")  # fmt: skip
_GROUPED = f"""WITH {LOCS}, {RUNS.format('locs')}, {_UNITS}, gm AS (SELECT grp, lag, sum(sum_sq) / sum(n) * {SCALE} AS msd FROM units GROUP BY grp, lag)"""
_add("M-10", lambda s, d: M.diffusion(M.group_msd(locs(s, d), LAG), LAG, loc_prec=0.001).select("group", rounded(F.col("d"), 6).alias("d")), f'{_GROUPED} SELECT CAST(grp AS INT) AS "group", round(regr_slope(msd, lag / {RATE}) / 4 - 0.001 * {RATE}, 6) + 0.0 AS d FROM gm GROUP BY grp')


def _track_d(by: str, source: str, name: str) -> str:
    """Slopes over lags 1..LAG of every unit of five rows, where a lag without pairs is 0."""
    return f"""{name}u AS ({_pairs(by, source, LAG)}),
{name}n AS (SELECT {by}, CAST(k AS INT) AS lag FROM (SELECT {by} FROM {source} GROUP BY {by} HAVING count(*) >= 5), range(1, {LAG + 1}) t(k)),
{name} AS (SELECT {by}, regr_slope(coalesce(sum_sq / n, 0) * {SCALE}, lag / {RATE}) / 4 AS d FROM {name}n LEFT JOIN {name}u USING ({by}, lag) GROUP BY {by})"""


_TD = f"WITH {LOCS}, {_track_d('cell_id, mol_id', 'locs', 'td')}"
_CD = f"WITH {LOCS}, {_track_d('cell_id, mol_id, class_label', 'locs', 'td')}"
_add("M-11", lambda s, d: M.track_diffusion(locs(s, d), LAG).select("cell_id", "mol_id", rounded(F.col("d"), 6).alias("d")), f"{_TD} SELECT cell_id, mol_id, round(d, 6) + 0.0 AS d FROM td")
_add("M-12", lambda s, d: M.class_diffusion(locs(s, d), LAG).select("cell_id", "mol_id", "class_label", rounded(F.col("d"), 6).alias("d")), f"{_CD} SELECT cell_id, mol_id, class_label, round(d, 6) + 0.0 AS d FROM td")
_add("M-13", lambda s, d: M.histogram(M.class_diffusion(locs(s, d), LAG), 0.05, by="class_label").select("class_label", "bin", rounded(F.col("low"), 6).alias("low"), "n"), f"""{_CD}, lo AS (SELECT min(d) AS lo FROM td)
SELECT class_label, CAST(floor((d - lo) / 0.05) AS BIGINT) AS bin, round(min(lo + floor((d - lo) / 0.05) * 0.05), 6) + 0.0 AS low, count(*) AS n FROM td, lo GROUP BY class_label, floor((d - lo) / 0.05)""")  # fmt: skip
_add("M-14", lambda s, d: M.gamma_mixture(M.class_diffusion(locs(s, d), LAG), 3, float(LAG)))
#: A mixture to take away from the histogram: component, mean, occupancy.
_MIX = [(0, 0.2, 0.5), (1, 1.0, 0.3), (2, 4.0, 0.2)]
_add("M-14-residuals", lambda s, d: M.mixture_residuals(M.class_diffusion(locs(s, d), LAG), s.createDataFrame(_MIX, "component int, mean double, occupancy double"), float(LAG), 0.05).select("bin", rounded(F.col("centre"), 6).alias("centre"), "n", rounded(F.col("fit"), 6).alias("fit"), rounded(F.col("residual"), 6).alias("residual")), f"""{_CD}, hb AS (SELECT CAST(floor(d / 0.05) AS BIGINT) AS bin, count(*) AS n FROM td WHERE d > 0 GROUP BY 1),
mx AS (SELECT * FROM (VALUES {', '.join(f'({m}, {o})' for _, m, o in _MIX)}) t(mean, occupancy)), gr AS (SELECT CAST(unnest(range(0, (SELECT max(bin) FROM hb) + 1)) AS BIGINT) AS bin),
ft AS (SELECT bin, CAST((bin + 0.5) * 0.05 AS DOUBLE) AS centre, sum(occupancy * exp({LAG} * ln({LAG} / mean) + ({LAG} - 1) * ln((bin + 0.5) * 0.05) - {LAG} * (bin + 0.5) * 0.05 / mean - lgamma({LAG})) * (SELECT sum(n) FROM hb) * 0.05) AS fit FROM gr, mx GROUP BY bin)
SELECT bin, round(centre, 6) + 0.0 AS centre, coalesce(n, 0) AS n, round(fit, 6) + 0.0 AS fit, round(coalesce(n, 0) - fit, 6) + 0.0 AS residual FROM ft LEFT JOIN hb USING (bin)""")  # fmt: skip
