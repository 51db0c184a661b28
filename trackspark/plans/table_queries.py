"""Queries of sources and sinks (S, K), statistics (X), training (L) and streams (R), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.ranks import numbered
from ..functions.storage import shared_dir, written
from ..operators import features as E
from ..operators import kinetics as T
from ..operators import msd as M
from ..operators import stats as X
from ..operators import training as L
from ..params import DEFAULT
from ..sources import readers as S
from ..sources import writers as K
from ..streaming import online as R
from .fixtures import LOCS, MESH, VIDEOS, cells, locs, mesh, videos
from .label_queries import ALIGN, EVENTS, ROWS, TK, TRAJ, _al, _prof, profile_columns, q, r, scores
from .track_queries import _CD, LAG, unlabelled

PX, RATE = DEFAULT.px_scale, DEFAULT.frame_rate
QUERIES, ORACLE = {}, {}
KEY = ["cell_id", "mol_id", "frame"]


def _add(key, query, sql=None):
    QUERIES[key] = query
    if sql:
        ORACLE[key] = sql


# Sources
def tracker_rows(s, d) -> DataFrame:
    """locs as the text columns of a tracker's file: two files by molecule, with header rows and a z of zeros."""
    x = locs(s, d).select((F.col("mol_id") % 2).cast("int").alias("file_idx"), F.lit("T").alias("LABEL"), (F.col("x_px") * PX / 1000).cast("string").alias("POSITION_X"), (F.col("y_px") * PX / 1000).cast("string").alias("POSITION_Y"), F.lit("0.0").alias("POSITION_Z"), (F.col("frame") - 1).cast("string").alias("FRAME"), F.floor(F.col("mol_id") / 2).cast("string").alias("TRACK_ID"), F.col("photons").cast("string").alias("MAX_INTENSITY_CH1"), F.lit("n/a").alias("NAME"))
    head = x.groupBy("file_idx").agg(*[F.lit(c.lower()).alias(c) for c in x.columns if c != "file_idx"])
    return x.unionByName(head)


_OFF = f"{VIDEOS}, vo AS (SELECT *, coalesce(sum(n_frames) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM videos)"


def _files(rows, n, header, sep=","):
    """Each file_idx of a table as a folder of CSV parts; their paths in order."""
    paths = []
    for k in range(n):
        paths.append(shared_dir(rows.sparkSession))
        rows.where(F.col("file_idx") == k).drop("file_idx").write.option("header", header).option("sep", sep).csv(paths[-1])
    return paths


_add("S-01", lambda s, d: S.tracker_tables(s, _files(tracker_rows(s, d), 2, True), videos(s)).select("file_idx", "mol_id", "frame", *r("x_px", "y_px"), rounded(F.col("max_intensity")).alias("max_intensity")), f"""WITH {LOCS}, {_OFF}, tp AS (SELECT mol_id % 2 AS f, max(CAST(floor(mol_id / 2) AS BIGINT)) + 1 AS top FROM locs GROUP BY 1)
SELECT CAST(mol_id % 2 AS INT) AS file_idx, CAST(floor(mol_id / 2) + CASE WHEN mol_id % 2 = 1 THEN (SELECT top FROM tp WHERE f = 0) ELSE 0 END AS BIGINT) AS mol_id, CAST(frame + o AS INT) AS frame, {q('x_px', 'x_px')}, {q('y_px', 'y_px')}, {q('photons', 'max_intensity', 4)} FROM locs JOIN vo ON file_idx = mol_id % 2""")  # fmt: skip
_add("S-02", lambda s, d: S.localisations(locs(s, d).select(F.col("x_px").alias("x"), F.col("y_px").alias("y"), (F.col("frame") - 1).alias("frame"), "photons", F.col("sigma_x_px").alias("sx"), "mol_id")), f"WITH {LOCS} SELECT x_px, y_px, frame, photons, sigma_x_px, mol_id FROM locs")
_add("S-03", lambda s, d: S.attach_localisations(locs(s, d).select(*KEY, "x_px", "y_px"), locs(s, d).select("cell_id", "frame", "x_px", "y_px", "photons", "sigma_x_px")), f"WITH {LOCS} SELECT a.cell_id, a.mol_id, a.frame, a.x_px, a.y_px, b.photons, b.sigma_x_px FROM locs a JOIN locs b USING (cell_id, frame, x_px, y_px) QUALIFY row_number() OVER (PARTITION BY a.cell_id, a.mol_id, a.frame ORDER BY b.photons, b.sigma_x_px) = 1")


def _outline_files(s, d):
    """Half of the cells as long rows of a CSV, half as a JSON table that holds the arrays, one cell without a mesh."""
    long, arrays = shared_dir(s), shared_dir(s)
    mesh(s, d).where("cell_id % 2 = 0").write.option("header", True).csv(long)
    empty = s.createDataFrame([(99, [])], "cell_id int, mesh array<struct<i:int,xl:double,yl:double,xr:double,yr:double>>")
    cells(s, d).where("cell_id % 2 = 1").select("cell_id", "mesh").unionByName(empty).write.json(arrays)
    return S.outline_files(s, long, "csv").unionByName(S.outline_files(s, arrays, "json"))


_add("S-04", lambda s, d: _outline_files(s, d).select("cell_id", F.posexplode("mesh").alias("pos", "m")).select("cell_id", F.col("m")["i"].alias("i"), *[F.col("m")[c].alias(c) for c in ("xl", "yl", "xr", "yr")]), f"WITH {MESH} SELECT * FROM mesh")


def truth_rows(s, d):
    return locs(s, d).select((F.col("mol_id") % 3).cast("int").alias("file_idx"), F.col("class_label").alias("class"), "frame", F.col("mol_id").alias("mol"), F.col("cell_id").alias("cell"))


_add("S-05", lambda s, d: S.ground_truth_files(s, _files(truth_rows(s, d), 3, False, "\t"), videos(s)), f"WITH {LOCS}, {_OFF} SELECT cell_id, mol_id, CAST(frame + o AS INT) AS frame, class_label FROM locs JOIN vo ON file_idx = mol_id % 3")


def segment_lines(s, d):
    t = locs(s, d).groupBy("mol_id").agg(F.count("*").alias("n"))
    return t.select(F.concat_ws(",", F.col("mol_id"), F.lit("0.25"), F.lit("9"), F.lit("1"), F.lit("20"), F.lit("1.5"), F.lit("9"), F.lit("2"), F.col("n")).alias("value"))


_add("S-06", lambda s, d: S.segmentation_lines(segment_lines(s, d)), f"WITH {LOCS}, t AS (SELECT mol_id, count(*) AS n FROM locs GROUP BY mol_id) SELECT mol_id AS traj_idx, 1 AS seg, CAST(0.25 AS DOUBLE) AS k, CAST(1 AS BIGINT) AS state, CAST(20 AS BIGINT) AS cp, n AS length FROM t UNION ALL SELECT mol_id, 2, 1.5, 2, n, n FROM t")


def file_videos(s, d):
    """A video for each cell, as long as its last frame."""
    return locs(s, d).groupBy(F.col("cell_id").alias("file_idx")).agg(F.max("frame").alias("n_frames"))


_FV = f"{LOCS}, fv AS (SELECT cell_id AS file_idx, max(frame) AS n_frames FROM locs GROUP BY cell_id), fo AS (SELECT *, coalesce(sum(n_frames) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame_offset FROM fv)"
_add("S-07", lambda s, d: S.frame_offsets(file_videos(s, d)), f"WITH {_FV} SELECT file_idx, n_frames, CAST(frame_offset AS BIGINT) AS frame_offset FROM fo")
_add("S-08", lambda s, d: S.find_frame(locs(s, d).select("mol_id", (F.col("frame") * 3).alias("frame")), file_videos(s, d)).select("mol_id", "frame", "file_idx", F.col("frame_in_file").cast("long").alias("frame_in_file")), f"WITH {_FV} SELECT mol_id, frame * 3 AS frame, file_idx, CAST(frame * 3 - frame_offset AS BIGINT) AS frame_in_file FROM locs JOIN fo ON frame * 3 > frame_offset AND frame * 3 <= frame_offset + n_frames")
_add("S-09", lambda s, d: S.union_datasets({"a": locs(s, d), "b": locs(s, d).withColumn("mol_id", F.col("mol_id") + 5_000_000)}).select("dataset_id", *KEY, "x_px"), f"WITH {LOCS} SELECT 'a' AS dataset_id, cell_id, mol_id, frame, x_px FROM locs UNION ALL SELECT 'b', cell_id, mol_id + 5000000, frame, x_px FROM locs")
# Sinks
def _through_csv(table: DataFrame) -> DataFrame:
    """The table as CSV files, read back."""
    path = shared_dir(table.sparkSession)
    K.write_csv(table, path)
    return table.sparkSession.read.csv(path, header=True, schema=table.schema)


_K01 = f"WITH {TRAJ} SELECT tj AS traj_idx, row - 1 AS frame, round(x_px - first_value(x_px) OVER {TK}, 6) + 0.0 AS x, round(y_px - first_value(y_px) OVER {TK}, 6) + 0.0 AS y FROM rw QUALIFY row <= "
_add("K-01", lambda s, d: _through_csv(K.segmenter_input(locs(s, d))).select("traj_idx", "frame", *r("x", "y")), _K01 + "200")
_add("K-01-50", lambda s, d: _through_csv(K.segmenter_input(locs(s, d), 50)).select("traj_idx", "frame", *r("x", "y")), _K01 + "50")


def _splits(s, d):
    return L.split(locs(s, d), {"train": 0.6, "validation": 0.2, "test": 0.2}, 7)


#: A share in 0..1 from a digest of a seed and a molecule, and the split that it falls in.
_U = "CAST(('0x' || substr(md5('7|' || cell_id || '|' || mol_id), 1, 8)) AS BIGINT) / 4294967296.0"
_SPLIT = f"CASE WHEN {_U} < 0.6 THEN 'train' WHEN {_U} < 0.8 THEN 'validation' ELSE 'test' END"


def _training_files(s, d):
    path = shared_dir(s)
    K.write_training(K.training_rows(_splits(s, d), ["photons"]), path)
    back = s.read.json(path, schema="split string, cell_id int, mol_id long, data array<array<double>>, labels array<int>")
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v[0])
    return back.select("cell_id", "mol_id", "split", F.size("data").cast("long").alias("n"), F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"), rounded(total).alias("photons"))


_add("K-02", _training_files, f"WITH {LOCS} SELECT cell_id, mol_id, {_SPLIT} AS split, count(*) AS n, string_agg(class_label, '' ORDER BY frame) AS labels, {q('sum(photons)', 'photons', 4)} FROM locs GROUP BY cell_id, mol_id")
_CLASSES = (1, 2, 3)
_add("K-03", lambda s, d: _through_csv(K.diffusion_binned(M.histogram(M.class_diffusion(locs(s, d), LAG), 0.05, by="class_label"), _CLASSES, 0.05)).select("bin", *r("centre"), *[f"class_{k}" for k in _CLASSES]), f"""{_CD}, lo AS (SELECT min(d) AS lo FROM td), b2 AS (SELECT class_label, CAST(floor((d - lo) / 0.05) AS BIGINT) AS bin, lo FROM td, lo)
SELECT bin, {q('max(lo) + (bin + 0.5) * 0.05', 'centre')}, count(*) FILTER (WHERE class_label = 1) AS class_1, count(*) FILTER (WHERE class_label = 2) AS class_2, count(*) FILTER (WHERE class_label = 3) AS class_3 FROM b2 GROUP BY bin""")  # fmt: skip
_add("K-03-raw", lambda s, d: _through_csv(K.diffusion_raw(M.class_diffusion(locs(s, d), LAG), _CLASSES)).select("row", *r("class_1", "class_2", "class_3")), f"""{_CD}, n AS (SELECT class_label, d, CAST(row_number() OVER (PARTITION BY class_label ORDER BY cell_id, mol_id) AS INT) AS row FROM td)
SELECT row, {', '.join(q(f'max(d) FILTER (WHERE class_label = {k})', f'class_{k}') for k in _CLASSES)} FROM n GROUP BY row""")  # fmt: skip
_add("K-04", lambda s, d: _through_csv(T.profile(_al(s, d)).select((F.col("rel") / RATE).alias("t"), *profile_columns())), f"WITH {ALIGN} SELECT rel / {RATE} AS t, {_prof} FROM (SELECT rel, nullif(value, 0) AS v FROM al) GROUP BY rel")
_add("K-04b", lambda s, d: _through_csv(K.event_matrix(_al(s, d))), f"WITH {ALIGN} SELECT concat_ws('-', cell_id, mol_id, event) AS event_id, rel, value FROM al")
_add("K-05", lambda s, d: _through_csv(locs(s, d).select(*KEY, "x_px", "photons")), f"WITH {LOCS} SELECT cell_id, mol_id, frame, x_px, photons FROM locs")
# Statistics
FEATS = ["x_px", "y_px", "photons", "step_nm"]


def _f(s, d):
    return E.step_size(locs(s, d))


FT = f"{LOCS}, ft AS (SELECT *, coalesce(sqrt(power(x_px - lag(x_px) OVER {TK}, 2) + power(y_px - lag(y_px) OVER {TK}, 2)), 0) * {PX} AS step_nm FROM locs)"
_add("X-01", lambda s, d: X.rows_with_class(locs(s, d), ["x_px", "photons"]), f"WITH {LOCS} SELECT x_px, photons, class_label AS class FROM locs")
_r = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
_add("X-02", lambda s, d: X.correlations(_f(s, d), FEATS).select("a", "b", *r("r")), f"WITH {FT} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q(_r(a, b), 'r')} FROM ft" for a in FEATS for b in FEATS))


def _bins(f, n=X.BINS, source="ft"):
    return f"""SELECT '{f}' AS feature, cell_id, mol_id, frame, class_label, CAST(least(len([v for v in e if v <= round({f}, 6)]), greatest(len(e) - 1, 1)) AS INT) AS bin
 FROM {source}, (SELECT list_sort(list_distinct([round(v, 6) for v in quantile_cont({f}, [{', '.join(str(k / n) for k in range(n + 1))}])])) AS e FROM {source})"""


BN = f"{FT}, bn AS ({' UNION ALL '.join(_bins(f) for f in FEATS)})"
MI = """mc AS (SELECT feature, bin, class_label, count(*) AS n FROM {0} GROUP BY ALL), mw AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS na, sum(n) OVER (PARTITION BY feature, class_label) AS nb, sum(n) OVER (PARTITION BY feature) AS al FROM mc),
mi AS (SELECT feature, sum(n / al * log2(n * al / (na * nb))) AS mi FROM mw GROUP BY feature)"""
_add("X-04", lambda s, d: X.binned(_f(s, d), FEATS, KEY).select("feature", *KEY, "bin"), f"WITH {BN} SELECT feature, cell_id, mol_id, frame, bin FROM bn")
for _k in ("X-03", "X-03b"):
    _fs = FEATS if _k == "X-03b" else ["photons"]
    _add(_k, lambda s, d, fs=_fs: X.mutual_information(_f(s, d), fs).select("feature", *r("mi")), f"WITH {BN}, {MI.format('bn')} SELECT feature, {q('mi', 'mi')} FROM mi" + ("" if _k == "X-03b" else " WHERE feature = 'photons'"))
_order = {f: i for i, f in enumerate(FEATS)}
_ab = " OR ".join(f"(a.feature = '{a}' AND b.feature = '{b}')" for a in FEATS for b in FEATS if _order[a] <= _order[b])
_add("X-05", lambda s, d: X.pairwise_information(_f(s, d), FEATS).select("a", "b", *r("mi")), f"""WITH {BN}, pc AS (SELECT a.feature AS a, b.feature AS b, a.bin AS x, b.bin AS y, count(*) AS n FROM bn a JOIN bn b USING (cell_id, mol_id, frame) WHERE {_ab} GROUP BY ALL),
pw AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS na, sum(n) OVER (PARTITION BY a, b, y) AS nb, sum(n) OVER (PARTITION BY a, b) AS al FROM pc)
SELECT a, b, {q('sum(n / al * log2(n * al / (na * nb)))', 'mi')} FROM pw GROUP BY a, b""")  # fmt: skip


def _prox(reach, source="locs"):
    return f"""px0 AS (SELECT *, CASE WHEN lead(class_label) OVER {TK} <> class_label THEN 1 ELSE 0 END AS cp FROM {source}),
px AS (SELECT *, max(cp) OVER (PARTITION BY cell_id, mol_id ORDER BY frame ROWS BETWEEN {reach} PRECEDING AND {reach - 1} FOLLOWING) = 1 AS proximal FROM px0)"""


_add("X-06", lambda s, d: X.proximal(locs(s, d), 4).select(*KEY, "proximal"), f"WITH {LOCS}, {_prox(4)} SELECT cell_id, mol_id, frame, proximal FROM px")
_add("X-07", lambda s, d: X.ranked(X.mutual_information(_f(s, d), FEATS)).select("feature", "rank", *r("mi")), f"WITH {BN}, {MI.format('bn')} SELECT feature, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INT) AS rank, {q('mi', 'mi')} FROM mi")
_near, _far = (" UNION ALL ".join(_bins(f, source=x) for f in FEATS) for x in ("(SELECT * FROM px WHERE proximal)", "(SELECT * FROM px WHERE NOT proximal)"))


def _mi_of(name):
    return MI.format(name).replace("mc AS", f"mc_{name} AS").replace("FROM mc)", f"FROM mc_{name})").replace("mw AS", f"mw_{name} AS").replace("FROM mw ", f"FROM mw_{name} ").replace("mi AS (SELECT", f"mi_{name} AS (SELECT")


_add("X-07b", lambda s, d: X.ranked_by_regions(_f(s, d), FEATS, 4).select("feature", "rank", *r("near", "far", "total")), f"""WITH {FT}, {_prox(4, 'ft')}, bnn AS ({_near}), bnf AS ({_far}), {_mi_of('bnn')}, {_mi_of('bnf')}
SELECT n.feature, CAST(row_number() OVER (ORDER BY n.mi + f.mi DESC, n.feature) AS INT) AS rank, {q('n.mi', 'near')}, {q('f.mi', 'far')}, {q('n.mi + f.mi', 'total')} FROM mi_bnn n JOIN mi_bnf f USING (feature)""")  # fmt: skip
def _discovered(show):
    return lambda s, d: X.discover(_f(s, d).withColumn("x_nm", F.col("x_px") * PX), ["x_px"], ["y_px", "photons", "step_nm", "x_nm"], 0.95, 0.001, show=show).select("feature", "rank", "predictive", *r("mi"))


_XN = f"{FT}, fx AS (SELECT *, x_px * {PX} AS x_nm FROM ft)"
_OTHERS = ("y_px", "photons", "step_nm", "x_nm")
_DISC = f"""WITH {_XN}, bd AS ({' UNION ALL '.join(_bins(f, source='fx') for f in _OTHERS)}), {MI.format('bd')},
cc AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, abs({_r('x_px', f)}) AS corr FROM fx" for f in _OTHERS)})
SELECT feature, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INT) AS rank, mi >= 0.001 AS predictive, {q('mi', 'mi')} FROM mi JOIN cc USING (feature)"""
_add("X-08", _discovered("predictive"), f"{_DISC} WHERE corr <= 0.95 AND mi >= 0.001")
_add("X-08-new", _discovered("new"), f"{_DISC} WHERE corr <= 0.95")
_add("X-08-all", _discovered("all"), _DISC)
CD = f"{LOCS}, cd AS (SELECT class_label AS class, CAST(floor(photons / 25) AS BIGINT) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY class_label) / 25 AS density FROM locs GROUP BY class_label, floor(photons / 25))"
_add("X-09", lambda s, d: X.class_distribution(locs(s, d), "photons", 25.0).select("class", "bin", *r("density", digits=8)), f"WITH {CD} SELECT class, bin, {q('density', 'density', 8)} FROM cd")
_add("X-09-smoothed", lambda s, d: X.smoothed_distribution(X.class_distribution(locs(s, d), "photons", 25.0), 1.0).select("class", "bin", *r("density", digits=8)), f"""WITH {CD}, kk AS (SELECT CAST(k AS INT) AS k, exp(-power(k, 2) / 2.0) AS w FROM range(-3, 4) t(k)), kn AS (SELECT k, w / (SELECT sum(w) FROM kk) AS w FROM kk)
SELECT class, bin + k AS bin, {q('sum(density * w)', 'density', 8)} FROM cd, kn GROUP BY class, bin + k""")  # fmt: skip
_add("X-09-kde", lambda s, d: X.kernel_density(locs(s, d), "photons", 0.0, 200.0, 21, 20.0).select("class", *r("x"), *r("density", digits=8)), f"WITH {LOCS} SELECT class_label AS class, {q('g * 10.0', 'x')}, {q('sum(exp(-power((photons - g * 10.0) / 20, 2) / 2)) / (count(*) * 20 * sqrt(2 * pi()))', 'density', 8)} FROM locs, range(0, 21) t(g) GROUP BY class_label, g")
_REACH, _N = 4, 20
_ROW = f"rw AS (SELECT *, row_number() OVER {TK} AS row FROM (SELECT * FROM (SELECT *, row_number() OVER {TK} AS r0 FROM ft) WHERE r0 > 1)), nx AS (SELECT *, lead(class_label) OVER {TK} AS ahead FROM rw)"
_REGION = {
    "all": f"rg AS (SELECT class_label AS class, step_nm AS v FROM nx WHERE class_label IN (1, 2))",
    "proximal": f"rg AS (SELECT c.class_label AS class, n.step_nm AS v FROM nx c JOIN nx n USING (cell_id, mol_id) WHERE ((c.class_label = 1 AND c.ahead = 2) OR (c.class_label = 2 AND c.ahead = 1)) AND n.row BETWEEN c.row - {_REACH} + 1 AND c.row + {_REACH})",
    "distal": f"rg AS (SELECT class_label AS class, step_nm AS v FROM nx n WHERE class_label IN (1, 2) AND NOT EXISTS (SELECT 1 FROM nx c WHERE c.cell_id = n.cell_id AND c.mol_id = n.mol_id AND c.ahead <> c.class_label AND n.row BETWEEN c.row - {_REACH} + 1 AND c.row + {_REACH}))",
}


def _region(which, make, columns):
    return lambda s, d: make(X.regions(_f(s, d), 1, 2, _REACH, which, start=1)).select("class", *columns())


for _w, _rg in _REGION.items():
    _add(f"X-09-{_w}", _region(_w, lambda t: X.point_histogram(t, "step_nm", _N), lambda: ["bin", *r("x", "density", digits=7)]), f"""WITH {FT}, {_ROW}, {_rg}, en AS (SELECT class, min(v) AS lo, (max(v) - min(v)) / {_N} AS wd, count(*) AS n FROM rg GROUP BY class)
SELECT class, CAST(least(floor((v - lo) / wd), {_N - 1}) AS BIGINT) AS bin, {q(f'max(lo + (least(floor((v - lo) / wd), {_N - 1}) + 0.5) * wd)', 'x', 7)}, {q('count(*) / max(n) / max(wd)', 'density', 7)} FROM rg JOIN en USING (class) GROUP BY class, least(floor((v - lo) / wd), {_N - 1})""")  # fmt: skip
_add("X-09-kde-positive", _region("all", lambda t: X.positive_density(t, "step_nm", 0.2, 31), lambda: [*r("x", digits=5), *r("density", digits=7)]), f"""WITH {FT}, {_ROW}, {_REGION["all"]}, lg AS (SELECT class, ln(v) AS u FROM rg WHERE v > 0), en AS (SELECT class, min(u) - 0.6 AS lo, max(u) + 0.6 AS hi, count(*) AS n FROM lg GROUP BY class),
gr AS (SELECT class, lo + g * (hi - lo) / 30 AS u0, n FROM en, range(0, 31) t(g))
SELECT class, {q('exp(u0)', 'x', 5)}, {q('sum(exp(-power((u - u0) / 0.2, 2) / 2)) / (max(n) * 0.2 * sqrt(2 * pi())) / exp(u0)', 'density', 7)} FROM gr JOIN lg USING (class) GROUP BY class, u0""")  # fmt: skip
_add("X-10", lambda s, d: X.kolmogorov_smirnov(_f(s, d), "step_nm", 1, 2).select(*r("d")), f"WITH {FT}, v AS (SELECT step_nm, count(*) FILTER (WHERE class_label = 1) AS x, count(*) FILTER (WHERE class_label = 2) AS y FROM ft WHERE class_label IN (1, 2) GROUP BY step_nm), cu AS (SELECT sum(x) OVER o / sum(x) OVER () AS a, sum(y) OVER o / sum(y) OVER () AS b FROM v WINDOW o AS (ORDER BY step_nm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT {q('max(abs(a - b))', 'd')} FROM cu")


def _rule(d: DataFrame) -> DataFrame:
    """A fixed classifier to take apart: the class by step size."""
    p = F.when(F.col("step_nm") < 30, 1).when(F.col("step_nm") < 90, 2).otherwise(3)
    return X.masked_accuracy(d.withColumn("guess", p), "class_label", "guess")


def _dealt_sql(losses: list[tuple[str, int]], source: str = "ft", where: str = "true") -> str:
    """Losses of accuracy of the rule by step size with a feature dealt anew for a seed: rows by key get the values of rows by digest."""
    guess = "CASE WHEN {0} < 30 THEN 1 WHEN {0} < 90 THEN 2 ELSE 3 END"
    right = "avg(CASE WHEN {0} = class_label THEN 1.0 ELSE 0.0 END) FILTER (WHERE {1})"
    one = []
    for f, k in losses:
        v = "b.v" if f == "step_nm" else "a.step_nm"
        one.append(f"""SELECT '{f}' AS feature, (SELECT {right.format(guess.format('step_nm'), where)} FROM {source}) - {right.format(guess.format(v), where)} AS loss
FROM (SELECT *, row_number() OVER (ORDER BY cell_id, mol_id, frame) AS r FROM {source}) a JOIN (SELECT {f} AS v, row_number() OVER (ORDER BY md5('{k}|' || cell_id || '|' || mol_id || '|' || frame), cell_id, mol_id, frame) AS r FROM {source}) b USING (r)""")
    return f"ls AS ({' UNION ALL '.join(one)}), im AS (SELECT feature, avg(loss) AS importance, stddev_samp(loss) AS std FROM ls GROUP BY feature) SELECT feature, {q('importance', 'importance')}, {q('std', 'std')}, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank FROM im"


_IMP = lambda x: x.select("feature", *r("importance", "std"), "rank")
_add("X-11", lambda s, d: _IMP(X.permutation_importance(_f(s, d), ["step_nm", "photons"], _rule, 2)), f"WITH {FT}, {_dealt_sql([('step_nm', 0), ('step_nm', 1), ('photons', 0), ('photons', 1)])}")


def _consensus_rule(mask):
    def score(d: DataFrame) -> DataFrame:
        near = X.proximal(d, 4).withColumn("row", F.row_number().over(E.track()))
        p = F.when(F.col("step_nm") < 30, 1).when(F.col("step_nm") < 90, 2).otherwise(3)
        w = near.withColumn("guess", p)
        one = w.select("cell_id", "mol_id", (F.col("row") - 1).alias("start"), F.lit(1).alias("offset"), F.col("guess").alias("class"), F.lit(1.0).alias("p"))
        from ..operators.annotate import consensus

        c = consensus(one).select("cell_id", "mol_id", "row", "label")
        return X.masked_accuracy(w.join(c, ["cell_id", "mol_id", "row"]), "class_label", "label", None if mask is None else F.col("proximal") == mask)

    return score


_add("X-11b", lambda s, d: _IMP(X.permutation_importance(_f(s, d), ["step_nm"], _consensus_rule(None), 1)), f"WITH {FT}, {_dealt_sql([('step_nm', 0)])}")
_add("X-11c", lambda s, d: _IMP(X.permutation_importance(_f(s, d), ["step_nm"], _consensus_rule(True), 1)), f"WITH {FT}, {_prox(4, 'ft')}, {_dealt_sql([('step_nm', 0)], 'px', 'proximal')}")
_add("X-11d", lambda s, d: X.proximal(locs(s, d), 3).groupBy("proximal").agg(F.count("*").alias("n")), f"WITH {LOCS}, {_prox(3)} SELECT proximal, count(*) AS n FROM px GROUP BY proximal")
_add("X-12", lambda s, d: X.masked_accuracy(X.proximal(locs(s, d), 4), "class_label", "pred_label", F.col("proximal")).select(*r("accuracy"), "rows"), f"WITH {LOCS}, {_prox(4)} SELECT {q('avg(CASE WHEN class_label = pred_label THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(*) AS rows FROM px WHERE proximal")
# Training
_add("L-01", lambda s, d: L.training_table(_f(s, d).withColumn("class_label", F.when(F.col("mol_id") % 10 == 0, -1).otherwise(F.col("class_label"))), ["step_nm", "photons"], start=1).select(*KEY, *r("step_nm", "photons"), "class_label"), f"""WITH {FT}, cr AS (SELECT *, row_number() OVER {TK} AS row FROM ft WHERE mol_id % 10 <> 0 QUALIFY row_number() OVER {TK} > 1)
SELECT cell_id, mol_id, frame, {', '.join(q(f'({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER ()', f) for f in ('step_nm', 'photons'))}, class_label FROM cr""")  # fmt: skip
_add("L-02", lambda s, d: L.scale(L.scale(_f(s, d), L.scaling(_f(s, d), ["photons"], "minmax"), ["photons"]), L.scaling(_f(s, d), ["photons"], "minmax"), ["photons"], invert=True).select(*KEY, *r("photons", digits=4)), f"WITH {LOCS} SELECT cell_id, mol_id, frame, {q('photons', 'photons', 4)} FROM locs")
_add("L-03", lambda s, d: L.order_by_hash(locs(s, d), 3).groupBy("cell_id", "mol_id", "shuffle_key").agg(F.count("*").alias("n")), f"WITH {LOCS} SELECT cell_id, mol_id, md5('3|' || cell_id || '|' || mol_id) AS shuffle_key, count(*) AS n FROM locs GROUP BY cell_id, mol_id")
_add("L-04", lambda s, d: _splits(s, d).select(*KEY, "split"), f"WITH {LOCS} SELECT cell_id, mol_id, frame, {_SPLIT} AS split FROM locs")


def _pads(s, d, length):
    p = L.padded(locs(s, d), ["photons"], length)
    return p.select("cell_id", "mol_id", F.posexplode(F.arrays_zip("x", "y", "mask")).alias("i", "e")).select("cell_id", "mol_id", (F.col("i") + 1).alias("row"), F.col("e")["x"][0].alias("photons"), F.col("e")["y"].alias("label"), F.col("e")["mask"].alias("mask"))


_PADS = f"WITH {ROWS}, gg AS (SELECT cell_id, mol_id, CAST(unnest(range(1, most + 1)) AS INT) AS row FROM (SELECT DISTINCT cell_id, mol_id FROM locs), (SELECT max(n) AS most FROM rw)) SELECT g.cell_id, g.mol_id, g.row, coalesce(photons, 0) AS photons, coalesce(class_label, 0) AS label, CAST(r.row IS NOT NULL AS INT) AS mask FROM gg g LEFT JOIN rw r USING (cell_id, mol_id, row)"
_add("L-05", lambda s, d: _pads(s, d, None), _PADS)
_add("L-05-80", lambda s, d: _pads(s, d, 80), _PADS.replace("SELECT max(n) AS most FROM rw", "SELECT 80 AS most"))
_add("L-06", lambda s, d: L.context_length(locs(s, d)), f"WITH {LOCS} SELECT min(n) - 9 AS context FROM (SELECT count(*) AS n FROM locs GROUP BY cell_id, mol_id)")
_add("L-07", lambda s, d: L.spans(locs(s, d), 20), f"WITH {LOCS} SELECT cell_id, mol_id, CAST(unnest(range(1, n - 20 + 2, 20)) AS INT) AS start FROM (SELECT cell_id, mol_id, count(*) AS n FROM locs GROUP BY ALL HAVING count(*) >= 20)")
_add("L-07-random", lambda s, d: L.spans(locs(s, d), 20, 5, 1), f"""WITH {LOCS}, st AS (SELECT cell_id, mol_id, CAST(unnest(range(1, n - 20 + 2)) AS INT) AS start FROM (SELECT cell_id, mol_id, count(*) AS n FROM locs GROUP BY ALL HAVING count(*) >= 20))
SELECT cell_id, mol_id, start FROM st QUALIFY row_number() OVER (PARTITION BY cell_id, mol_id ORDER BY md5('1|' || cell_id || '|' || mol_id || '|' || start)) <= 5""")  # fmt: skip
_add("L-08", lambda s, d: L.windows(locs(s, d), ["photons"], 20).select("cell_id", "mol_id", "start", rounded(F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])).alias("total")), f"WITH {ROWS} SELECT cell_id, mol_id, CAST(row AS INT) AS start, {q('sum(photons) OVER (PARTITION BY cell_id, mol_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)', 'total', 4)} FROM rw QUALIFY row <= n - 19")
_add("L-09", lambda s, d: L.changepoint_mask(locs(s, d)).select(*KEY, "mask"), f"WITH {LOCS}, {_prox(3)} SELECT cell_id, mol_id, frame, CAST(proximal AS INT) AS mask FROM px")
CW = "cw AS (SELECT class_label AS class, 1.0 / count(*) / sum(1.0 / count(*)) OVER () * count(*) OVER () AS weight FROM locs GROUP BY class_label)"
_add("L-10", lambda s, d: L.class_weights(locs(s, d)).select("class", *r("weight")), f"WITH {LOCS}, {CW} SELECT class, {q('weight', 'weight')} FROM cw")
_P = "CASE WHEN class_label = pred_label THEN 0.5 + (frame % 5) / 10.0 ELSE 0.0 END"
_add("L-11", lambda s, d: L.weighted_cross_entropy(L.changepoint_mask(locs(s, d)).withColumn("p", F.expr(_P)), L.class_weights(locs(s, d)), "p", "mask").select(*r("loss")), f"WITH {LOCS}, {CW}, {_prox(3)} SELECT {q(f'sum(-ln(greatest({_P}, 1e-10)) * (1 + 2 * CAST(proximal AS INT)) * weight) / sum((1 + 2 * CAST(proximal AS INT)) * weight)', 'loss')} FROM px JOIN cw ON class = class_label")


def _forest(s, d):
    data = L.split(E.turn_angle(_f(s, d)), {"train": 0.7, "test": 0.3}, 1)
    fs = ["step_nm", "turn_angle", "photons"]
    return fs, data, L.train_forest(data.where("split = 'train'"), fs)


def _importance(s, d):
    fs, data, model = _forest(s, d)
    m = L.metrics(L.score_forest(model, data.where("split = 'test'")), "class_label", "pred")
    w = s.createDataFrame([(f, float(v)) for f, v in zip(fs, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")
    return w.join(m, F.lit(True))


_add("L-12", lambda s, d: L.out_of_bag_importance(E.turn_angle(_f(s, d)), ["step_nm", "turn_angle", "photons"], trees=6, seed=1).select("feature", *r("importance", "increase"), "rank"))
_add("L-12-gain", _importance)
_add("L-13", lambda s, d: (lambda f: L.score_forest(f[2], f[1]).select(*KEY, "pred", "p"))(_forest(s, d)))


def _window_scorer(x):
    """Scores by the distance of each position's step to a class's usual one."""
    return [[[-abs(v[0] - m) / 30 for m in (20.0, 60.0, 130.0)] for v in w] for w in x]


# the scorer looks at one position alone, so a row's probabilities are the same in all windows over it
_W = DEFAULT.window
_add("L-14", lambda s, d: L.score_windows(_f(s, d), ["step_nm"], _W, _window_scorer, 3).select("cell_id", "mol_id", "row", "label", *r("confidence"), "windows"), f"""WITH {FT}, rw AS (SELECT *, row_number() OVER {TK} AS row, count(*) OVER (PARTITION BY cell_id, mol_id) AS n FROM ft),
pr AS (SELECT cell_id, mol_id, row, least(row, n - {_W - 1}) - greatest(1, row - {_W - 1}) + 1 AS windows, {', '.join(f'exp(-abs(step_nm - {m}) / 30) AS p{k}' for k, m in ((1, 20.0), (2, 60.0), (3, 130.0)))} FROM rw WHERE n >= {_W})
SELECT cell_id, mol_id, CAST(row AS INT) AS row, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS label, {q('greatest(p1, p2, p3) / (p1 + p2 + p3)', 'confidence')}, CAST(windows AS BIGINT) AS windows FROM pr""")  # fmt: skip
#: Rows before and after a position that its label is told by, of the trained scorer.
_NEAR = 3


def _trained_windows(s, d):
    """L-08, training on seven tracks in ten, K-06 there and back, and the consensus of all windows of the others."""
    data = L.split(_f(s, d), {"train": 0.7, "test": 0.3}, 5)
    model = L.train_windows(data.where("split = 'train'"), ["step_nm"], _W, _NEAR, trees=5)
    path = shared_dir(s)
    K.save_model(model, path, {"features": ["step_nm"], "window": _W, "reach": _NEAR})
    back, record = K.load_model(s, path)
    test = data.where("split = 'test'")
    return L.score_trained_windows(back, test, record["features"], record["window"], record["reach"]).select("cell_id", "mol_id", "row", "label", *r("confidence"), "windows")


_add("L-14-trained", _trained_windows)
for _k in ("L-15", "L-15b"):
    _add(_k, lambda s, d: L.score_tracks(_f(s, d), ["step_nm"], None, lambda x: [[1 if v[0] < 30 else 2 if v[0] < 90 else 3 for v in t] for t in x]), f"WITH {FT} SELECT cell_id, mol_id, CAST(row_number() OVER {TK} AS INT) AS row, CASE WHEN step_nm < 30 THEN 1 WHEN step_nm < 90 THEN 2 ELSE 3 END AS label FROM ft")
_add("L-16", lambda s, d: L.cross_validate(E.turn_angle(_f(s, d)), ["step_nm", "turn_angle"], 2, trees=5))
_MET = """cl AS (SELECT c AS class, sum(CASE WHEN actual = c AND predicted = c THEN n ELSE 0 END) AS tp, sum(CASE WHEN actual = c THEN n ELSE 0 END) AS act, sum(CASE WHEN predicted = c THEN n ELSE 0 END) AS pre FROM cf, (SELECT DISTINCT actual AS c FROM cf UNION SELECT DISTINCT predicted FROM cf) GROUP BY c)"""
_ms = f"SELECT {q('(SELECT sum(n) FILTER (WHERE actual = predicted) / sum(n) FROM cf)', 'accuracy')}, {q('avg(coalesce(tp / nullif(pre, 0), 0))', 'precision')}, {q('avg(coalesce(tp / nullif(act, 0), 0))', 'recall')}, {q('avg(coalesce(2 * tp / nullif(pre + act, 0), 0))', 'f1')}, {q('avg(coalesce(tp / nullif(pre + act - tp, 0), 0))', 'jaccard')} FROM cl"
_names = ("accuracy", "precision", "recall", "f1", "jaccard")
_add("L-17", lambda s, d: L.metrics(locs(s, d), "class_label", "pred_label").select(*r(*_names)), f"WITH {LOCS}, cf AS (SELECT class_label AS actual, pred_label AS predicted, count(*) AS n FROM locs GROUP BY ALL), {_MET} {_ms}")
_add("L-17b", lambda s, d: L.metrics(locs(s, d).withColumn("mask", (F.col("frame") % 3 != 0).cast("int")), "class_label", "pred_label", "mask").select(*r(*_names)), f"WITH {LOCS}, cf AS (SELECT class_label AS actual, pred_label AS predicted, count(*) AS n FROM locs WHERE frame % 3 <> 0 GROUP BY ALL), {_MET} {_ms}")


def _saved(s, d):
    fs, data, model = _forest(s, d)
    path = shared_dir(s)
    K.save_model(model, path, {"features": fs, "classes": [1, 2, 3]})
    back, record = K.load_model(s, path)
    return L.score_forest(back, data).select(*KEY, "pred").withColumn("features", F.lit(",".join(record["features"])))


_add("K-06", _saved)


# Streams
def _fed(s, parts, schema, make):
    """The table that a stream writes: each part arrives while the stream is down, which then goes on where it was. Returns the table, and how many rows were late."""
    src, out, log, late = shared_dir(s), shared_dir(s), shared_dir(s), 0
    for part in parts:
        part.write.mode("append").parquet(src)
        stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(src)
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        late += R.late_rows(q)
    return s.read.parquet(out), late


_POINTS = "cell_id int, frame int, x_px double, y_px double"


def _linked_stream(s, d):
    """The localisations in four parts, out of order: rows of any frame come in two parts that follow each other. Then a far row of no cell, so that the watermark passes all."""
    points = written(locs(s, d).select("cell_id", "frame", "x_px", "y_px").withColumn("part", F.least(F.floor(F.col("frame") / 150) + F.pmod(F.xxhash64("x_px", "y_px"), F.lit(2)), F.lit(4)).cast("int")))
    parts = [points.where(F.col("part") == k).drop("part") for k in range(5)]
    end = points.agg(F.lit(-1).alias("cell_id"), (F.max("frame") + 10_000).cast("int").alias("frame"), F.lit(0.0).alias("x_px"), F.lit(0.0).alias("y_px"))
    out, late = _fed(s, [*parts, end], _POINTS, lambda x: R.link_stream(x, delay=300))
    if late:
        raise ValueError(f"{late} rows came too late")
    # ids grow in the order of starts: numbered from 1 they are those of link_tracks()
    tracks = numbered(out.select("cell_id", F.col("mol_id").alias("_id")).distinct(), ["cell_id"], ["_id"], "mol_id", "long")
    return out.withColumnRenamed("mol_id", "_id").join(tracks.hint("merge"), ["cell_id", "_id"]).select("cell_id", "frame", "x_px", "y_px", "mol_id")


_add("R-01", _linked_stream)


def _arrival_stream(s, d):
    """The events in three parts that overlap in time, through a stream of arrivals into a stream of counts. Two far events of no user close all sessions and windows."""
    events = s.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = Window.partitionBy("user_id").orderBy("ts")
    silent = events.withColumn("gap", F.col("ts").cast("long") - F.lag("ts").over(w).cast("long")).groupBy("user_id").agg(F.max("gap").alias("g"), (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("l"))
    gap, long, first, last = (int(x or 0) for x in silent.agg(F.max("g"), F.max("l")).join(events.agg(F.min("ts").cast("long"), F.max("ts").cast("long")), F.lit(True)).first())
    third = (last - first) // 3 + 1
    part = F.least(F.floor((F.col("ts").cast("long") - first) / third) + F.pmod(F.xxhash64("ts", "user_id"), F.lit(2)), F.lit(2))
    far = lambda k: s.createDataFrame([(-k, last + k * 10 * (third + gap + long + 7200))], "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    parts = [events.withColumn("part", part).where(F.col("part") == k).drop("part") for k in range(3)]
    came, late = _fed(s, [*parts, far(1), far(2)], "user_id long, ts timestamp", lambda x: R.arrivals(x, "user_id", "ts", f"{gap + 1} seconds", f"{2 * third} seconds"))
    counts, later = _fed(s, [came], "user_id long, arrived timestamp", lambda x: R.arrival_counts(x, "1 hour", f"{long + gap + 2 * third} seconds"))
    if late or later:
        raise ValueError(f"{late + later} rows came too late")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_add("R-02", _arrival_stream, "SELECT strftime(date_trunc('hour', f), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT min(ts) AS f FROM events GROUP BY user_id) GROUP BY 1")
