"""Queries of spatial operators (G) and maps (H), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import maps as H
from ..operators import spatial as G
from ..params import DEFAULT
from .fixtures import LOCS, MESH, cells, locs
from .label_queries import q, r

PX = DEFAULT.px_scale
QUERIES, ORACLE = {}, {}
KEY = ["cell_id", "mol_id", "frame"]


def _add(key, query, sql=None):
    QUERIES[key] = query
    if sql:
        ORACLE[key] = sql


#: Outlines in long form: k is the vertex, in order.
OUTLINE = f"""{MESH}, ol AS (SELECT cell_id, i AS k, xl AS x, yl AS y FROM mesh UNION ALL SELECT cell_id, 20 - i AS k, xr, yr FROM mesh WHERE i BETWEEN 1 AND 9),
nb AS (SELECT a.*, p.x - n.x AS dx, p.y - n.y AS dy FROM ol a JOIN ol p ON p.cell_id = a.cell_id AND p.k = (a.k + 19) % 20 JOIN ol n ON n.cell_id = a.cell_id AND n.k = (a.k + 1) % 20),
xp AS (SELECT cell_id, k, x - (-1.2) * dy / sqrt(dx * dx + dy * dy) AS x, y + (-1.2) * dx / sqrt(dx * dx + dy * dy) AS y FROM nb),
tu AS (SELECT *, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM xp WINDOW w AS (PARTITION BY cell_id ORDER BY k)),
roi AS (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY k) - 1 AS k, count(*) OVER (PARTITION BY cell_id) AS n, x, y FROM tu WHERE ux IS NULL OR vx IS NULL OR degrees(atan2(abs(ux * vy - uy * vx), ux * vx + uy * vy)) > 1),
ed AS (SELECT a.cell_id, a.k, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM roi a JOIN roi b ON b.cell_id = a.cell_id AND b.k = (a.k + 1) % a.n)"""


def long(df, name):
    return df.select("cell_id", F.posexplode(name).alias("k", "p")).select("cell_id", F.col("k").cast("long").alias("k"), rounded(F.col("p")["x"]).alias("x"), rounded(F.col("p")["y"]).alias("y"))


def roi(s, d):
    return G.with_box(G.with_roi(cells(s, d)))


_left_right = lambda c: F.concat(G.arms(F.col("mesh"))[0], F.reverse(F.slice(G.arms(F.col("mesh"))[1], 2, F.size("mesh") - 2)))
_add("G-01", lambda s, d: long(G.with_roi(cells(s, d)), "roi"), f"WITH {OUTLINE} SELECT cell_id, k, {q('x', 'x', 4)}, {q('y', 'y', 4)} FROM roi")
_add("G-02", lambda s, d: long(cells(s, d).withColumn("o", _left_right(None)).withColumn("o", G.expand(F.col("o"), -1.2)), "o"), f"WITH {OUTLINE} SELECT cell_id, CAST(k AS BIGINT) AS k, {q('x', 'x', 4)}, {q('y', 'y', 4)} FROM xp")
_add("G-03", lambda s, d: G.with_roi(cells(s, d)).select("cell_id", F.size("roi").cast("long").alias("n")), f"WITH {OUTLINE} SELECT cell_id, count(*) AS n FROM roi GROUP BY cell_id")
_add("G-04", lambda s, d: G.flip(locs(s, d), 512.0).select(*KEY, *r("y_px")), f"WITH {LOCS} SELECT cell_id, mol_id, frame, {q('512.0 - y_px', 'y_px')} FROM locs")
_add("G-05", lambda s, d: roi(s, d).select("cell_id", *r("x_min", "x_max", "y_min", "y_max", digits=4)), f"WITH {OUTLINE} SELECT cell_id, {q('min(x)', 'x_min', 4)}, {q('max(x)', 'x_max', 4)}, {q('min(y)', 'y_min', 4)}, {q('max(y)', 'y_max', 4)} FROM roi GROUP BY cell_id")


def points(s, d):
    """Every localisation as a point; cells are shifted copies, so that points lie in several."""
    return locs(s, d).withColumn("id", F.col("mol_id") * 100000 + F.col("frame")).select("id", F.col("mol_id").alias("track_id"), "frame", "x_px", "y_px")


def shifted(s, d):
    c = G.with_roi(cells(s, d))
    return G.with_box(c.withColumn("roi", F.transform("roi", lambda p: G.point(p["x"] + F.col("cell_id") * 3.0, p["y"] + F.col("cell_id") * 1.5))))


_CROSS = "count(*) FILTER (WHERE (ay > y_px) <> (qy > y_px) AND x_px < (qx - ax) * (y_px - ay) / nullif(qy - ay, 0) + ax) % 2 = 1"
_CLAMP = "greatest(0, least(1, ((x_px - ax) * (qx - ax) + (y_px - ay) * (qy - ay)) / nullif(power(qx - ax, 2) + power(qy - ay, 2), 0)))"
_SEG = f"sqrt(power(x_px - ax - {_CLAMP} * (qx - ax), 2) + power(y_px - ay - {_CLAMP} * (qy - ay), 2))"
_HIT = f"""{LOCS}, {OUTLINE}, pt AS (SELECT mol_id * 100000 + frame AS id, mol_id AS track_id, frame, x_px, y_px FROM locs),
es AS (SELECT cell_id, ax + 3.0 * cell_id AS ax, ay + 1.5 * cell_id AS ay, qx + 3.0 * cell_id AS qx, qy + 1.5 * cell_id AS qy FROM ed),
hit AS (SELECT id, track_id, frame, x_px, y_px, cell_id, min({_SEG}) AS depth FROM pt, es GROUP BY ALL HAVING {_CROSS})"""
_add("G-06", lambda s, d: G.assign_points(points(s, d), shifted(s, d)).select("id", "cell_id", *r("depth", digits=4)), f"WITH {_HIT} SELECT id, cell_id, {q('depth', 'depth', 4)} FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC, cell_id) = 1")
_add("G-07", lambda s, d: G.assign_tracks(points(s, d), shifted(s, d)).select("track_id", "cell_id", *r("share")), f"WITH {_HIT}, tn AS (SELECT track_id, count(*) AS n FROM pt GROUP BY track_id HAVING count(*) >= 5) SELECT h.track_id, h.cell_id, {q('count(*) / any_value(n)', 'share')} FROM hit h JOIN tn USING (track_id) GROUP BY h.track_id, h.cell_id HAVING count(*) > 0.5 * any_value(n) QUALIFY row_number() OVER (PARTITION BY h.track_id ORDER BY h.cell_id) = 1")
_MEM = f"WITH {LOCS}, {OUTLINE} SELECT l.cell_id, mol_id, frame, {{}} FROM locs l JOIN ed e ON e.cell_id = l.cell_id GROUP BY l.cell_id, mol_id, frame"
_add("G-08c", lambda s, d: G.membrane_distance(locs(s, d), G.with_roi(cells(s, d))).select(*KEY, *r("membrane_nm", digits=4)), _MEM.format(q(f"min({_SEG}) * {PX}", "membrane_nm", 4)))
_add("G-08", lambda s, d: G.membrane_distance(locs(s, d), G.with_roi(cells(s, d))).select(*KEY, rounded(F.col("membrane_nm") / PX).alias("d")), _MEM.format(q(f"min({_SEG})", "d", 4)))


def _one_segment(s, d):
    e = F.struct(G.point(F.lit(2.0), F.lit(20.0)).alias("a"), G.point(F.lit(42.0), F.lit(25.0)).alias("b"))
    return locs(s, d).select(*KEY, G.projected(G.point(F.col("x_px"), F.col("y_px")), e).alias("p")).select(*KEY, *[rounded(F.col("p")[c], 7).alias(c) for c in ("x", "y", "d")])


_T1 = "greatest(0, least(1, ((x_px - 2) * 40 + (y_px - 20) * 5) / 1625.0))"
_seg_sql = f"WITH {LOCS} SELECT cell_id, mol_id, frame, {q(f'2 + {_T1} * 40', 'x', 7)}, {q(f'20 + {_T1} * 5', 'y', 7)}, {q(f'sqrt(power(x_px - 2 - {_T1} * 40, 2) + power(y_px - 20 - {_T1} * 5, 2))', 'd', 7)} FROM locs"
_add("G-08b", _one_segment, _seg_sql)
_add("G-11", _one_segment, _seg_sql)
_ENDS = "(SELECT cell_id, max(CASE WHEN i = 0 THEN (xl + xr) / 2 END) AS x0, max(CASE WHEN i = 0 THEN (yl + yr) / 2 END) AS y0, max(CASE WHEN i = 10 THEN (xl + xr) / 2 END) AS x1, max(CASE WHEN i = 10 THEN (yl + yr) / 2 END) AS y1 FROM mesh GROUP BY cell_id)"
_add("G-09", lambda s, d: G.pole_distance(locs(s, d), cells(s, d)).select(*KEY, *r("pole_nm", digits=4)), f"WITH {LOCS}, {MESH} SELECT cell_id, mol_id, frame, {q(f'least(sqrt(power(x_px - x0, 2) + power(y_px - y0, 2)), sqrt(power(x_px - x1, 2) + power(y_px - y1, 2))) * {PX}', 'pole_nm', 4)} FROM locs JOIN {_ENDS} USING (cell_id)")


def _cross(a: str, b: str) -> str:
    """Segments from a to b (names of coordinate columns) that a ray to the right of a point crosses."""
    (ax, ay), (bx, by) = a.split(), b.split()
    return f"CASE WHEN ({ay} > y_px) <> ({by} > y_px) AND x_px < ({bx} - {ax}) * (y_px - {ay}) / nullif({by} - {ay}, 0) + {ax} THEN 1 ELSE 0 END"


def _to(a: str, b: str) -> str:
    """Distance of a point to a segment."""
    (ax, ay), (bx, by) = a.split(), b.split()
    t = f"greatest(0, least(1, coalesce(((x_px - {ax}) * ({bx} - {ax}) + (y_px - {ay}) * ({by} - {ay})) / nullif(power({bx} - {ax}, 2) + power({by} - {ay}, 2), 0), 0)))"
    return f"sqrt(power(x_px - {ax} - {t} * ({bx} - {ax}), 2) + power(y_px - {ay} - {t} * ({by} - {ay}), 2))"


#: Every point against every midline segment a-b, with the segments of the arms beside it, p-q on the left and r-s on the right.
_COORDS = f"""{LOCS}, {MESH}, mid AS (SELECT *, (xl + xr) / 2 AS mx, (yl + yr) / 2 AS my FROM mesh),
sg0 AS (SELECT a.cell_id, a.i, a.mx AS ax, a.my AS ay, b.mx AS bx, b.my AS by_, a.xl AS px, a.yl AS py, b.xl AS qx, b.yl AS qy, a.xr AS rx, a.yr AS ry, b.xr AS sx, b.yr AS sy, sqrt(power(b.mx - a.mx, 2) + power(b.my - a.my, 2)) AS len FROM mid a JOIN mid b ON b.cell_id = a.cell_id AND b.i = a.i + 1),
sg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY cell_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER (PARTITION BY cell_id) AS contour, max(i) OVER (PARTITION BY cell_id) AS last FROM sg0),
j0 AS (SELECT l.cell_id, mol_id, frame, x_px, y_px, sg.* EXCLUDE (cell_id), greatest(0, least(1, ((x_px - ax) * (bx - ax) + (y_px - ay) * (by_ - ay)) / power(len, 2))) AS t FROM locs l JOIN sg ON sg.cell_id = l.cell_id),
j1 AS (SELECT *, CASE WHEN t >= 1 THEN bx WHEN t <= 0 THEN ax ELSE ax + t * (bx - ax) END AS tx, CASE WHEN t >= 1 THEN by_ WHEN t <= 0 THEN ay ELSE ay + t * (by_ - ay) END AS ty FROM j0),
j2 AS (SELECT *, sqrt(power(x_px - tx, 2) + power(y_px - ty, 2)) AS d FROM j1),
near AS (SELECT * FROM j2 QUALIFY row_number() OVER (PARTITION BY cell_id, mol_id, frame ORDER BY d, i) = 1),
side AS (SELECT cell_id, mol_id, frame, CASE WHEN sum({_cross('ax ay', 'bx by_')} + {_cross('px py', 'qx qy')}) % 2 = 1 THEN true WHEN sum({_cross('ax ay', 'bx by_')} + {_cross('rx ry', 'sx sy')}) % 2 = 1 THEN false
  ELSE min({_to('px py', 'qx qy')}) < min({_to('rx ry', 'sx sy')}) END AS is_left FROM j2 GROUP BY cell_id, mol_id, frame),
k0 AS (SELECT n.*, is_left, CASE WHEN is_left THEN px ELSE rx END AS dx, CASE WHEN is_left THEN py ELSE ry END AS dy, CASE WHEN is_left THEN qx ELSE sx END AS ex, CASE WHEN is_left THEN qy ELSE sy END AS ey FROM near n JOIN side USING (cell_id, mol_id, frame)),
k1 AS (SELECT *, CASE WHEN x_px = tx AND y_px = ty THEN 0 ELSE 1 / nullif(abs(((dx - tx) * (ey - dy) - (dy - ty) * (ex - dx)) / nullif((x_px - tx) * (ey - dy) - (y_px - ty) * (ex - dx), 0)), 0) END AS lat FROM k0),
k2 AS (SELECT *, lat IS NULL OR (i = 0 AND t <= 0) AS beyond, CASE WHEN i = last AND t >= 1 THEN bx ELSE ax END AS fx, CASE WHEN i = last AND t >= 1 THEN by_ ELSE ay END AS fy, CASE WHEN i = last AND t >= 1 THEN ax ELSE bx END AS gx, CASE WHEN i = last AND t >= 1 THEN ay ELSE by_ END AS gy FROM k1),
k3 AS (SELECT *, abs((x_px - fx) * (gx - fx) + (y_px - fy) * (gy - fy)) / len AS far, abs((gx - fx) * (y_px - fy) - (gy - fy) * (x_px - fx)) / len AS off,
  (sqrt(power(dx - fx, 2) + power(dy - fy, 2)) + sqrt(power(ex - gx, 2) + power(ey - gy, 2))) / 2 AS half FROM k2),
k4 AS (SELECT *, CASE WHEN NOT beyond THEN before + sqrt(power(tx - ax, 2) + power(ty - ay, 2)) WHEN i = 0 THEN -far WHEN i = last THEN far + contour ELSE far END AS lon, CASE WHEN is_left THEN 1 ELSE -1 END AS sg FROM k3),
co AS (SELECT cell_id, mol_id, frame, lon / contour - 0.5 AS longitude, lon - contour / 2 AS longitude_px, sg * CASE WHEN beyond THEN off / half ELSE lat END / 2 AS latitude, sg * CASE WHEN beyond THEN off ELSE d END AS latitude_px, sg AS side, beyond FROM k4)"""


def _coords(s, d):
    return G.cell_coordinates(locs(s, d), cells(s, d))


def _middle(s, d):
    m = G.midlines(cells(s, d)).withColumns({"halves": F.array(F.size("left_half"), F.size("right_half"))})
    return m.select("cell_id", *r("contour"), F.col("halves")[0].alias("left_n"), F.col("halves")[1].alias("right_n"), F.posexplode("midline").alias("k", "p")).select("cell_id", "contour", "left_n", "right_n", "k", rounded(F.col("p")["x"]).alias("x"), rounded(F.col("p")["y"]).alias("y"))


_add("G-10", _middle, f"WITH {MESH}, m AS (SELECT cell_id, i, (xl + xr) / 2 AS x, (yl + yr) / 2 AS y FROM mesh), n AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS len FROM m WINDOW w AS (PARTITION BY cell_id ORDER BY i)) SELECT cell_id, {q('sum(len) OVER (PARTITION BY cell_id)', 'contour')}, 22 AS left_n, 22 AS right_n, i AS k, {q('x', 'x', 4)}, {q('y', 'y', 4)} FROM n")
_add("G-11b", lambda s, d: _coords(s, d).select(*KEY, *r("longitude", "longitude_px")), f"WITH {_COORDS} SELECT cell_id, mol_id, frame, {q('longitude', 'longitude')}, {q('longitude_px', 'longitude_px')} FROM co")
_add("G-12", lambda s, d: _coords(s, d).select(*KEY, "side"), f"WITH {_COORDS} SELECT cell_id, mol_id, frame, side FROM co")
_add("G-13", lambda s, d: _coords(s, d).select(*KEY, *r("latitude", "latitude_px")), f"WITH {_COORDS} SELECT cell_id, mol_id, frame, {q('latitude', 'latitude')}, {q('latitude_px', 'latitude_px')} FROM co")
_add("G-14", lambda s, d: _coords(s, d).where("beyond").select(*KEY, *r("longitude_px", "longitude", "latitude_px", "latitude")), f"WITH {_COORDS} SELECT cell_id, mol_id, frame, {q('longitude_px', 'longitude_px')}, {q('longitude', 'longitude')}, {q('latitude_px', 'latitude_px')}, {q('latitude', 'latitude')} FROM co WHERE beyond")
_add("G-15", lambda s, d: G.rotate(locs(s, d), 30.0).select(*KEY, *r("x_rot", "y_rot", digits=4)), f"WITH {LOCS} SELECT cell_id, mol_id, frame, {q('x_px * cos(radians(30)) - y_px * sin(radians(30))', 'x_rot', 4)}, {q('x_px * sin(radians(30)) + y_px * cos(radians(30))', 'y_rot', 4)} FROM locs")
_add("G-16", lambda s, d: G.link_tracks(locs(s, d).withColumnRenamed("mol_id", "true_mol")).select("cell_id", "frame", "true_mol", "mol_id", "x_px", "y_px"))
_add("G-18", lambda s, d: locs(s, d).select(*KEY, rounded(F.hypot(F.col("x_px") - 20, F.col("y_px") - 20)).alias("d")), f"WITH {LOCS} SELECT cell_id, mol_id, frame, {q('sqrt(power(x_px - 20, 2) + power(y_px - 20, 2))', 'd', 4)} FROM locs")

LEN, WID, BIN = 4.0, 1.6, 0.15


def model(s, d):
    return G.model_cell(_coords(s, d), LEN, WID)


MODEL = f"""{_COORDS}, p0 AS (SELECT co.*, class_label, longitude * {LEN} AS mx, latitude * {WID} AS y0 FROM co JOIN locs USING (cell_id, mol_id, frame)), p1 AS (SELECT *, abs(mx) - {LEN / 2 - WID / 2} AS cap FROM p0),
p2 AS (SELECT *, CASE WHEN power({WID / 2}, 2) - cap * cap >= 0 THEN sqrt(power({WID / 2}, 2) - cap * cap) END AS rad FROM p1),
p3 AS (SELECT *, CASE WHEN cap > 0 THEN y0 * rad / {WID / 2} ELSE y0 END AS my FROM p2),
md AS (SELECT *, CASE WHEN cap > 0 THEN rad IS NOT NULL AND abs(my) <= rad ELSE abs(y0) <= {WID / 2} END AS valid FROM p3)"""
NX, NY = H.bins(LEN, WID, BIN)


def _idx(c, size, n):
    return f"CAST(CASE WHEN {c} = {size / 2} THEN {n - 1} ELSE floor(({c} + {size / 2}) / ({size / n})) END AS INT)"


HB = f"{MODEL}, hb AS (SELECT *, {_idx('mx', LEN, NX)} AS bin_x, {_idx('my', WID, NY)} AS bin_y FROM md WHERE valid), hv AS (SELECT * FROM hb WHERE bin_x BETWEEN 0 AND {NX - 1} AND bin_y BETWEEN 0 AND {NY - 1})"
HS = f"{HB}, hs AS (SELECT class_label AS class, bin_x, bin_y, count(*) AS n FROM hv GROUP BY ALL UNION ALL SELECT 0, bin_x, bin_y, count(*) FROM hv GROUP BY ALL)"
_add("G-17", lambda s, d: model(s, d).select(*KEY, *r("mx", "my", digits=7), "valid"), f"WITH {MODEL} SELECT cell_id, mol_id, frame, {q('mx', 'mx', 7)}, {q('my', 'my', 7)}, coalesce(valid, false) AS valid FROM md")
for _k in ("H-01", "H-02"):
    _add(_k, lambda s, d: H.histogram(model(s, d), LEN, WID, BIN), f"WITH {HB} SELECT bin_x, bin_y, count(*) AS n FROM hv GROUP BY bin_x, bin_y")
_add("H-03", lambda s, d: H.by_class(model(s, d), LEN, WID, BIN), f"WITH {HS} SELECT class, bin_x, bin_y, n FROM hs")
_add("H-04", lambda s, d: H.projection(H.by_class(model(s, d), LEN, WID, BIN), "bin_x", NX, mirrored=True).select("class", "bin", *r("share")), f"""WITH {HS}, pr AS (SELECT class, bin_x AS bin, sum(n) / sum(sum(n)) OVER (PARTITION BY class) AS share FROM hs GROUP BY class, bin_x)
SELECT class, bin, {q('sum(share) / 2', 'share')} FROM (SELECT class, bin, share FROM pr UNION ALL SELECT class, {NX - 1} - bin, share FROM pr) GROUP BY class, bin""")  # fmt: skip
FWHM = 0.3
KERNEL = f"""kr AS (SELECT floor(6 * {FWHM} / (2 * sqrt(2 * ln(2))) / {BIN} + 1e-9) AS r), kx AS (SELECT CAST(unnest(range(CAST(-r AS BIGINT), CAST(r + 1 AS BIGINT))) AS INT) AS k FROM kr),
kw AS (SELECT a.k AS dx, b.k AS dy, exp(-(power(a.k * {BIN}, 2) + power(b.k * {BIN}, 2)) / (2 * power({FWHM} / (2 * sqrt(2 * ln(2))), 2))) AS w FROM kx a, kx b), kn AS (SELECT dx, dy, w / (SELECT sum(w) FROM kw) AS w FROM kw)"""


_add("H-06", lambda s, d: H.reconstruction(model(s, d), LEN, WID, BIN, FWHM).select("bin_x", "bin_y", *r("weight", digits=4)), f"""WITH {MODEL}, {KERNEL}, at_ AS (SELECT CAST(floor((mx + {LEN / 2}) / {LEN / NX} + 0.5) AS INT) AS px, CAST(floor((my + {WID / 2}) / {WID / NY} + 0.5) AS INT) AS py, count(*) AS n FROM md WHERE valid GROUP BY ALL)
SELECT px + dx AS bin_x, py + dy AS bin_y, {q('sum(n * w)', 'weight', 4)} FROM at_, kn WHERE px + dx BETWEEN 1 AND {NX} AND py + dy BETWEEN 1 AND {NY} GROUP BY 1, 2""")  # fmt: skip
