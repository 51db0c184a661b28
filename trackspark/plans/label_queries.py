"""Queries of kinetics (T) and annotations (A), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import annotate as A
from ..operators import features as E
from ..operators import kinetics as T
from ..operators import prepare as P
from ..params import DEFAULT
from .fixtures import LOCS, locs
from .track_queries import RUNS, TRUTH, UNLABELLED, truth, unlabelled

PX, RATE = DEFAULT.px_scale, DEFAULT.frame_rate
QUERIES, ORACLE = {}, {}
TK = "(PARTITION BY cell_id, mol_id ORDER BY frame)"


def _add(key, query, sql=None):
    QUERIES[key] = query
    if sql:
        ORACLE[key] = sql


def r(*names, digits=6):
    return [rounded(F.col(n).cast("double"), digits).alias(n) for n in names]


def q(x, name, digits=6):
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


FULL = f"{UNLABELLED}, lab AS (SELECT * FROM unl WHERE mol_id % 10 <> 0)"
_STARTS = f"st AS (SELECT cell_id, mol_id, frame, class_label FROM locs QUALIFY coalesce(lag(class_label) OVER {TK}, -9) <> class_label)"
_add("T-01", lambda s, d: T.state_sequence(locs(s, d)).select("cell_id", "mol_id", "sequence"), f"WITH {LOCS}, {_STARTS} SELECT cell_id, mol_id, string_agg(class_label, '' ORDER BY frame) AS sequence FROM st GROUP BY cell_id, mol_id")
_TIMES = f"times AS (SELECT class_label AS state, count(*) / {RATE} AS time FROM lab GROUP BY class_label)"
_add("T-02", lambda s, d: T.state_times(unlabelled(s, d)).select("state", *r("time", "share")), f"WITH {FULL}, {_TIMES} SELECT state, {q('time', 'time')}, {q('time / sum(time) OVER ()', 'share')} FROM times")
_add("T-03", lambda s, d: T.transitions(unlabelled(s, d)).select("from", "to", "n", *r("rate")), f"""WITH {FULL}, {_TIMES},
mv AS (SELECT p AS f, class_label AS t, count(*) AS n FROM (SELECT *, lag(class_label) OVER {TK} AS p FROM lab) WHERE p <> class_label GROUP BY ALL)
SELECT a.state AS "from", b.state AS "to", coalesce(n, 0) AS n, {q('coalesce(n, 0) / a.time', 'rate')} FROM times a JOIN times b ON a.state <> b.state LEFT JOIN mv ON f = a.state AND t = b.state""")  # fmt: skip
_add("T-04", lambda s, d: T.summary(P.drop_short(unlabelled(s, d), 60), locs(s, d)).select("molecules_before", "molecules", "labelled", *r("observation_time", "experiment_time", "progress")), f"""WITH {UNLABELLED},
k AS (SELECT * FROM unl QUALIFY count(*) OVER (PARTITION BY cell_id, mol_id) >= 60), t AS (SELECT mol_id, count(*) AS n, max(frame) AS last FROM k GROUP BY cell_id, mol_id)
SELECT (SELECT count(DISTINCT mol_id) FROM locs) AS molecules_before, count(*) AS molecules, CAST(count(*) FILTER (WHERE mol_id % 10 <> 0) AS BIGINT) AS labelled,
 {q(f'sum(n) / {RATE}', 'observation_time')}, {q(f'max(last) / {RATE}', 'experiment_time')}, {q('count(*) FILTER (WHERE mol_id % 10 <> 0) * 100.0 / count(*)', 'progress')} FROM t""")  # fmt: skip
_add("T-04b", lambda s, d: T.observation_times(locs(s, d)).select("cell_id", "mol_id", *r("observed")), f"WITH {LOCS} SELECT cell_id, mol_id, {q(f'count(*) / {RATE}', 'observed')} FROM locs GROUP BY cell_id, mol_id")
_add("T-05", lambda s, d: T.arrivals(locs(s, d)).select("cell_id", "mol_id", "first_frame", *r("first_time")), f"WITH {LOCS} SELECT cell_id, mol_id, min(frame) AS first_frame, {q(f'min(frame) / {RATE}', 'first_time')} FROM locs GROUP BY cell_id, mol_id")
_add("T-05-histogram", lambda s, d: T.arrival_histogram(locs(s, d), 10.0), f"WITH {LOCS} SELECT CAST(floor(t / 10) AS BIGINT) AS bin, count(*) AS n FROM (SELECT min(frame) / {RATE} AS t FROM locs GROUP BY cell_id, mol_id) GROUP BY 1")
EVENTS = f"""{FULL}, {RUNS.format('lab')},
ev AS (SELECT cell_id, mol_id, run, class_label AS state, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS rows FROM runs GROUP BY ALL),
ends AS (SELECT cell_id, mol_id, min(frame) AS lo, max(frame) AS hi FROM lab GROUP BY cell_id, mol_id),
events_ AS (SELECT ev.cell_id, ev.mol_id, run, state, first_frame, last_frame, CASE WHEN rows = 1 THEN 1 ELSE last_frame - first_frame END / {RATE} AS duration, first_frame = lo AS left_truncated, last_frame = hi AS right_truncated FROM ev JOIN ends USING (cell_id, mol_id))"""
_E = ["cell_id", "mol_id", "run", "state", "first_frame", "last_frame"]
_ES = f"SELECT cell_id, mol_id, run, state, first_frame, last_frame, {q('duration', 'duration')}, left_truncated, right_truncated FROM events_"
_flags = ["left_truncated", "right_truncated"]
_add("T-06", lambda s, d: T.events(unlabelled(s, d)).select(*_E, *r("duration"), *_flags), f"WITH {EVENTS} {_ES}")
_add("T-06b", lambda s, d: T.state_events(unlabelled(s, d), 2).select(*_E, *r("duration"), *_flags), f"WITH {EVENTS} {_ES} WHERE state = 2")
_add("F-14", lambda s, d: P.event_filter(T.events(unlabelled(s, d)), "single").select(*_E, *r("duration"), *_flags), f"WITH {EVENTS} {_ES} WHERE left_truncated <> right_truncated")
BIN = f"""bi AS (SELECT *, CASE WHEN class_label = 2 THEN 1 ELSE 0 END AS ins FROM locs), bc AS (SELECT *, CASE WHEN lag(ins) OVER {TK} <> ins THEN 1 ELSE 0 END AS chg FROM bi),
br AS (SELECT *, sum(chg) OVER {TK} AS brun FROM bc), bn AS (SELECT cell_id, mol_id, brun, max(ins) AS ins, min(frame) AS a, max(frame) AS b FROM br GROUP BY ALL),
bw AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb, lag(a) OVER w AS pa FROM bn WINDOW w AS (PARTITION BY cell_id, mol_id ORDER BY brun)),
ex_ AS (SELECT cell_id, mol_id, a AS start, na AS "exit", nb AS "end" FROM bw WHERE ins = 1 AND na IS NOT NULL),
en_ AS (SELECT cell_id, mol_id, pa AS start, a AS entrance, b AS "end" FROM bw WHERE ins = 1 AND pa IS NOT NULL)"""
_add("T-07", lambda s, d: T.exits(locs(s, d), 2), f"WITH {LOCS}, {BIN} SELECT * FROM ex_")
_add("T-08", lambda s, d: T.entrances(locs(s, d), 2), f"WITH {LOCS}, {BIN} SELECT * FROM en_")
FILL = f"""sp AS (SELECT cell_id, mol_id, min(frame) AS lo, max(frame) AS hi FROM locs GROUP BY ALL), gr AS (SELECT cell_id, mol_id, CAST(unnest(range(lo, hi + 1)) AS INT) AS frame FROM sp),
fl AS (SELECT g.cell_id, g.mol_id, g.frame, last_value(l.class_label IGNORE NULLS) OVER (PARTITION BY g.cell_id, g.mol_id ORDER BY g.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS class_label, l.photons FROM gr g LEFT JOIN locs l USING (cell_id, mol_id, frame))"""
_add("T-09", lambda s, d: T.fill_gaps(locs(s, d), ["photons"]), f"WITH {LOCS}, {FILL} SELECT * FROM fl")
ALIGN = f"{LOCS}, {BIN}, {FILL}, al AS (SELECT e.cell_id, e.mol_id, e.\"exit\" AS event, f.frame - e.\"exit\" AS rel, f.photons AS value FROM ex_ e JOIN fl f ON f.cell_id = e.cell_id AND f.mol_id = e.mol_id AND f.frame BETWEEN e.start AND e.\"end\")"


def profile_columns():
    return [rounded(F.col(c) + OFF_TIES, 6).alias(c) for c in ("mean", "median", "std", "var", "sem")]


def _al(s, d):
    return T.aligned(locs(s, d), "photons", 2)


_add("T-10", _al, f"WITH {ALIGN} SELECT * FROM al")
OFF_TIES = 3.1e-9  # added before rounding: means of two-place numbers end on ties
_prof = ", ".join(q(f"{x} + {OFF_TIES}", n) for n, x in (("mean", "avg(v)"), ("median", "median(v)"), ("std", "stddev_samp(v)"), ("var", "var_samp(v)"), ("sem", "stddev_samp(v) / sqrt(count(v))")))
_add("T-11", lambda s, d: T.profile(_al(s, d)).select("rel", "n", *profile_columns()), f"WITH {ALIGN} SELECT rel, count(v) AS n, {_prof} FROM (SELECT rel, nullif(value, 0) AS v FROM al) GROUP BY rel")
_add("T-12", lambda s, d: T.trimmed(_al(s, d).withColumn("value", F.when(F.abs(F.col("rel")) < 10, F.col("value")))), f"WITH {ALIGN} SELECT cell_id, mol_id, event, rel, value FROM al WHERE abs(rel) < 10")
_add("T-13", lambda s, d: T.profile_histogram(_al(s, d), 50.0, -5, 5).select("rel", "bin", *r("share")), f"WITH {ALIGN} SELECT rel, CAST(floor(value / 50) AS BIGINT) AS bin, {q('count(*) / sum(count(*)) OVER (PARTITION BY rel)', 'share')} FROM al WHERE rel BETWEEN -5 AND 5 AND value IS NOT NULL GROUP BY rel, floor(value / 50)")
_add("T-14", lambda s, d: T.count_changes(locs(s, d)), f"""WITH {LOCS}, mv AS (SELECT *, lag(class_label) OVER {TK} AS p FROM locs), ch2 AS (SELECT p, class_label AS c FROM mv WHERE p <> class_label)
SELECT state, CAST(sum(i) AS BIGINT) AS entrances, CAST(sum(o) AS BIGINT) AS exits FROM (SELECT c AS state, 1 AS i, 0 AS o FROM ch2 UNION ALL SELECT p, 0, 1 FROM ch2) GROUP BY state""")  # fmt: skip
_add("T-15", lambda s, d: T.longest_mixed_track(unlabelled(s, d), 2), f"WITH {FULL} SELECT max(n) AS longest FROM (SELECT max(frame) - min(frame) + 1 AS n FROM lab GROUP BY cell_id, mol_id HAVING bool_or(class_label = 2) AND bool_or(class_label <> 2))")
_add("T-16", lambda s, d: T.dwell_histogram(P.event_filter(T.events(unlabelled(s, d)), "full"), 2, 0.5), f"WITH {EVENTS} SELECT CAST(floor(duration / 0.5) AS BIGINT) AS bin, count(*) AS n FROM events_ WHERE state = 2 AND NOT left_truncated AND NOT right_truncated GROUP BY 1")
STEPS = f"{LOCS}, sz AS (SELECT *, sqrt(power(x_px - lag(x_px) OVER w, 2) + power(y_px - lag(y_px) OVER w, 2)) * {PX} AS step_nm, row_number() OVER w AS row FROM locs WINDOW w AS (PARTITION BY cell_id, mol_id ORDER BY frame))"
_add("T-17", lambda s, d: T.step_profile(E.step_size(locs(s, d)), 20.0), f"WITH {STEPS} SELECT CAST(floor(step_nm / 20) AS BIGINT) AS bin, count(*) AS n FROM sz WHERE row > 1 GROUP BY 1")
_add("T-17-first", lambda s, d: T.step_profile(E.step_size(locs(s, d)), 20.0, 10), f"WITH {STEPS} SELECT CAST(floor(step_nm / 20) AS BIGINT) AS bin, count(*) AS n FROM sz WHERE row BETWEEN 2 AND 11 GROUP BY 1")


def ann(s, d):
    """Two sources: truth without every seventh molecule, and the model with every tenth unlabelled."""
    t = locs(s, d).where("mol_id % 7 <> 0").select(F.lit("truth").alias("source"), "cell_id", "mol_id", "frame", "class_label")
    m = locs(s, d).select(F.lit("model").alias("source"), "cell_id", "mol_id", "frame", F.when(F.col("mol_id") % 10 == 0, -1).otherwise(F.col("pred_label")).alias("class_label"))
    return t.unionByName(m)


def pred(s, d):
    return locs(s, d).withColumn("class_label", F.col("pred_label"))


_T, _M = (lambda s, d: locs(s, d)), pred
_add("A-01", lambda s, d: A.common_tracks(ann(s, d), 2), f"WITH {LOCS} SELECT DISTINCT cell_id, mol_id FROM locs WHERE mol_id % 7 <> 0")
_add("A-02", lambda s, d: A.common_labelled_tracks(ann(s, d), 2), f"WITH {LOCS} SELECT DISTINCT cell_id, mol_id FROM locs WHERE mol_id % 7 <> 0 AND mol_id % 10 <> 0")
CONF = f"{LOCS}, rw AS (SELECT *, row_number() OVER {TK} AS row, count(*) OVER (PARTITION BY cell_id, mol_id) AS n FROM locs), cf AS (SELECT class_label AS actual, pred_label AS predicted, count(*) AS n FROM rw WHERE row > 1 AND row <= n - 1 GROUP BY ALL)"


def _cf(s, d):
    return A.confusion(_T(s, d), _M(s, d), 1, 1)


_add("A-03", _cf, f"WITH {CONF} SELECT * FROM cf")
CLS = """cl AS (SELECT c AS class, sum(CASE WHEN actual = c AND predicted = c THEN n ELSE 0 END) AS tp, sum(CASE WHEN actual = c THEN n ELSE 0 END) AS act, sum(CASE WHEN predicted = c THEN n ELSE 0 END) AS pre, sum(n) AS al
 FROM cf, (SELECT DISTINCT actual AS c FROM cf UNION SELECT DISTINCT predicted FROM cf) GROUP BY c),
cm AS (SELECT class, (al - act - pre + 2 * tp) / al AS accuracy, coalesce(tp / nullif(pre, 0), 0) AS precision, coalesce(tp / nullif(act, 0), 0) AS recall, coalesce(2 * tp / nullif(pre + act, 0), 0) AS f1, coalesce(tp / nullif(pre + act - tp, 0), 0) AS jaccard FROM cl)"""
_mets = ("accuracy", "precision", "recall", "f1", "jaccard")
_add("A-04", lambda s, d: A.class_metrics(_cf(s, d)).select("class", *r(*_mets)), f"WITH {CONF}, {CLS} SELECT class, {', '.join(q(m, m) for m in _mets)} FROM cm")
MACRO = f"SELECT {q('(SELECT sum(n) FILTER (WHERE actual = predicted) / sum(n) FROM cf)', 'accuracy')}, {', '.join(q(f'avg({m})', m) for m in _mets[1:])} FROM cm"
_add("A-04-macro", lambda s, d: A.macro_metrics(_cf(s, d)).select(*r(*_mets)), f"WITH {CONF}, {CLS} {MACRO}")


def _cps(name, label):
    return f"""{name}0 AS (SELECT cell_id, mol_id, row_number() OVER {TK} AS row, {label} AS t, lag({label}) OVER {TK} AS f FROM locs),
{name} AS (SELECT *, least(row - lag(row) OVER w, lead(row) OVER w - row) AS gap FROM {name}0 WHERE f <> t WINDOW w AS (PARTITION BY cell_id, mol_id ORDER BY row))"""


CPE = f"""{LOCS}, {_cps('tc', 'class_label')}, {_cps('mc', 'pred_label')},
nn AS (SELECT a.cell_id, a.mol_id, a.row, a.f, a.t, m.row - a.row AS e FROM tc a LEFT JOIN mc m ON m.cell_id = a.cell_id AND m.mol_id = a.mol_id AND m.f = a.f AND m.t = a.t WHERE a.gap IS NULL OR a.gap >= 3
 QUALIFY row_number() OVER (PARTITION BY a.cell_id, a.mol_id, a.row ORDER BY abs(m.row - a.row) NULLS LAST, m.row) = 1),
er AS (SELECT cell_id, mol_id, row, f AS "from", t AS "to", CASE WHEN abs(e) <= 6 THEN e ELSE 6 END AS err, coalesce(abs(e) <= 6, false) AS paired FROM nn)"""
_add("A-05", lambda s, d: A.changepoint_errors(_T(s, d), _M(s, d), 3, 6).select("cell_id", "mol_id", "row", "from", "to", F.col("err").cast("long").alias("err"), "paired"), f"WITH {CPE} SELECT * FROM er")
_add("A-05-summary", lambda s, d: A.changepoint_summary(A.changepoint_errors(_T(s, d), _M(s, d), 3, 6)).select("n", "paired", *r("mean_abs", "rmse")), f"WITH {CPE} SELECT count(*) AS n, CAST(sum(CAST(paired AS INT)) AS BIGINT) AS paired, {q('avg(abs(err))', 'mean_abs')}, {q('sqrt(avg(err * err))', 'rmse')} FROM er")
# the model's tracks are two rows shorter, so that positions up to the shorter track count
_add("A-06", lambda s, d: A.two_class_agreement(_T(s, d), P.crop(_M(s, d), 0, 2)).select("tp", "tn", "fp", "fn", *r("accuracy", "recall", "precision", "specificity", "f1")), f"""WITH {LOCS}, k AS (SELECT count(*) FILTER (WHERE class_label = pred_label AND pred_label = 1) AS tp, count(*) FILTER (WHERE class_label = pred_label AND pred_label <> 1) AS tn,
 count(*) FILTER (WHERE class_label <> pred_label AND pred_label = 1) AS fp, count(*) FILTER (WHERE class_label <> pred_label AND pred_label <> 1) AS fn FROM (SELECT *, row_number() OVER {TK} AS row, count(*) OVER (PARTITION BY cell_id, mol_id) AS n FROM locs) WHERE row <= n - 2)
SELECT tp, tn, fp, fn, {q('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {q('tp / (tp + fn)', 'recall')}, {q('tp / (tp + fp)', 'precision')}, {q('tn / (tn + fp)', 'specificity')}, {q('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM k""")  # fmt: skip
_add("A-07", lambda s, d: A.attach_truth(locs(s, d), truth(s, d), by_mol=True).select("cell_id", "mol_id", "frame", "truth_label"), f"WITH {TRUTH} SELECT l.cell_id, l.mol_id, l.frame, t.class_label AS truth_label FROM locs l LEFT JOIN truth t USING (cell_id, mol_id, frame)")
_add("A-07-frame", lambda s, d: A.attach_truth(locs(s, d), truth(s, d)).select("cell_id", "mol_id", "frame", "truth_label"), f"WITH {TRUTH} SELECT l.cell_id, l.mol_id, l.frame, t.lab AS truth_label FROM locs l LEFT JOIN (SELECT cell_id, frame, arg_max(class_label, mol_id) AS lab FROM truth GROUP BY ALL) t USING (cell_id, frame)")
_add("A-08", lambda s, d: A.shift_truth(locs(s, d)).select("cell_id", "mol_id", "frame", "shifted"), f"WITH {LOCS} SELECT cell_id, mol_id, frame, coalesce(lag(class_label) OVER {TK}, class_label) AS shifted FROM locs")


def scores(s, d, w=DEFAULT.window):
    """Class probabilities of every window of w rows, from whole numbers."""
    n = locs(s, d).groupBy("cell_id", "mol_id").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= w)
    x = n.select("cell_id", "mol_id", F.explode(F.sequence(F.lit(1), F.col("n") - w + 1)).alias("start")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))).withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(3))))
    weight = 1 + (F.col("mol_id") + F.col("start") + F.col("offset") * F.col("class")) % 7
    whole = sum((1 + (F.col("mol_id") + F.col("start") + F.col("offset") * k) % 7 for k in (2, 3)), 1 + (F.col("mol_id") + F.col("start") + F.col("offset")) % 7)
    return x.withColumn("p", weight / whole)


SCORES = f"""{LOCS}, nw AS (SELECT cell_id, mol_id, count(*) AS n FROM locs GROUP BY ALL HAVING count(*) >= 20),
wn AS (SELECT cell_id, mol_id, unnest(range(1, n - 20 + 2)) AS start FROM nw),
sc AS (SELECT w.cell_id, w.mol_id, start, o.o AS ofs, k.k AS class, (1 + (mol_id + start + o * k) % 7) / CAST(3 + (mol_id + start + o) % 7 + (mol_id + start + o * 2) % 7 + (mol_id + start + o * 3) % 7 AS DOUBLE) AS p FROM wn w, range(0, 20) o(o), range(1, 4) k(k)),
cs AS (SELECT cell_id, mol_id, start + ofs AS row, class, sum(p) AS p, count(*) AS windows FROM sc GROUP BY ALL)"""
_add("A-09", lambda s, d: A.consensus(scores(s, d).withColumn("p", F.round(F.col("p") * 1e6).cast("long"))).select("cell_id", "mol_id", F.col("row").cast("long").alias("row"), F.col("label").cast("long").alias("label"), *r("confidence"), "windows"), f"""WITH {SCORES.replace('sum(p) AS p', 'sum(CAST(round(p * 1e6) AS BIGINT)) AS p')}
SELECT cell_id, mol_id, row, arg_min(class, (-p, class)) AS label, {q('max(p) / sum(p)', 'confidence')}, max(windows) AS windows FROM cs GROUP BY cell_id, mol_id, row""")  # fmt: skip


def marks(s, d):
    m = locs(s, d).groupBy("cell_id", "mol_id").agg(F.count("*").alias("n"))
    return m.select("cell_id", "mol_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("class"), F.lit(q_).alias("seq")) for p, c, q_ in ((10, 1, 1), (25, 2, 2), (25, 3, 3), (40, 1, 4))])).alias("e")).select("cell_id", "mol_id", "e.*")


_MK = "CASE WHEN row <= 10 THEN 1 WHEN row <= 25 THEN 3 WHEN row <= 40 THEN 1 END"
ROWS = f"{LOCS}, rw AS (SELECT *, row_number() OVER {TK} AS row, count(*) OVER (PARTITION BY cell_id, mol_id) AS n FROM locs)"
_add("A-10", lambda s, d: A.apply_spans(locs(s, d), marks(s, d)).select("cell_id", "mol_id", "frame", "row", "label"), f"WITH {ROWS} SELECT cell_id, mol_id, frame, CAST(row AS INT) AS row, {_MK} AS label FROM rw")
_add("A-10-status", lambda s, d: A.track_status(A.apply_spans(locs(s, d), marks(s, d))), f"WITH {ROWS} SELECT cell_id, mol_id, max(n) <= 40 AS complete, count({_MK}) AS labelled_rows FROM rw GROUP BY cell_id, mol_id")
_add("A-11", lambda s, d: A.undo_last(locs(s, d)).select("cell_id", "mol_id", "frame", "class_label"), f"WITH {LOCS}, {RUNS.format('locs')} SELECT cell_id, mol_id, frame, CASE WHEN run < max(run) OVER (PARTITION BY cell_id, mol_id) THEN class_label END AS class_label FROM runs")


def segments(s, d):
    n = A.track_numbers(locs(s, d)).join(locs(s, d).groupBy("cell_id", "mol_id").agg(F.count("*").alias("length")), ["cell_id", "mol_id"])
    e = F.array(*[F.struct(F.lit(i).alias("seg"), (F.lit(k) + F.col("traj_idx") % 3).alias("k"), (1 + (F.lit(i) + F.col("traj_idx")) % 3).alias("state"), cp.alias("cp")) for i, k, cp in ((1, 0.5, F.lit(14).cast("long")), (2, 1.5, F.lit(29).cast("long")), (3, 2.5, F.col("length")))])
    return n.select("traj_idx", "length", F.explode(e).alias("e")).select("traj_idx", "length", "e.*")


TRAJ = f"{LOCS}, tn AS (SELECT cell_id, mol_id, row_number() OVER (ORDER BY cell_id, mol_id) - 1 AS tj FROM (SELECT DISTINCT cell_id, mol_id FROM locs)), rw AS (SELECT *, row_number() OVER {TK} AS row FROM locs JOIN tn USING (cell_id, mol_id))"
#: By states the first segment that reaches a row has it; by thresholds a segment whose end is not before the (capped) track's is taken over by later ones.
_A12 = f"WITH {TRAJ} SELECT cell_id, mol_id, frame, CASE WHEN row <= 200 THEN 1 + (CASE WHEN row <= 15 THEN 1 WHEN row <= 30 THEN 2 ELSE 3 END + tj) % 3 END AS label FROM rw"
_A12T = f"""WITH {TRAJ}, ln AS (SELECT *, least(count(*) OVER (PARTITION BY cell_id, mol_id), 200) AS len FROM rw),
kk AS (SELECT *, CASE WHEN len > 14 AND row <= 15 THEN 0.5 WHEN len > 29 AND row <= 30 THEN 1.5 ELSE 2.5 END + tj % 3 AS k FROM ln)
SELECT cell_id, mol_id, frame, CAST(CASE WHEN row <= 200 THEN 1 + CASE WHEN k >= 1 THEN 1 ELSE 0 END + CASE WHEN k >= 2 THEN 1 ELSE 0 END END AS BIGINT) AS label FROM kk"""
for _k, _cap in (("", 200), ("-50", 50)):
    _add(f"A-12{_k}", lambda s, d, c=_cap: A.external_labels(locs(s, d), segments(s, d), cap=c).select("cell_id", "mol_id", "frame", F.col("label").cast("long").alias("label")), _A12.replace("row <= 200", f"row <= {_cap}"))
    _add(f"A-12-thresholds{_k}", lambda s, d, c=_cap: A.external_labels(locs(s, d), segments(s, d), [1.0, 2.0], c).select("cell_id", "mol_id", "frame", F.col("label").cast("long").alias("label")), _A12T.replace("200", str(_cap)))
_add("A-13", lambda s, d: A.initialise(locs(s, d)).select("cell_id", "mol_id", "rows", *r("duration"), "status", "sequence"), f"WITH {LOCS} SELECT cell_id, mol_id, count(*) AS rows, {q(f'count(*) / {RATE}', 'duration')}, 'pending' AS status, CAST(NULL AS VARCHAR) AS sequence FROM locs GROUP BY cell_id, mol_id")
_add("A-15", lambda s, d: A.inspect(ann(s, d), locs(s, d), "photons", 1, 1, ["truth", "model"]).select("frame", *r("time"), "photons", "truth", "model"), f"WITH {LOCS} SELECT frame, {q(f'frame / {RATE}', 'time')}, photons, class_label AS truth, pred_label AS model FROM locs WHERE cell_id = 1 AND mol_id = 1")
