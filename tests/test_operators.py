"""Hand-made cases, small restatements and properties."""

import math

import pytest
from pyspark.sql import functions as F

from trackspark.operators import annotate, features, kinetics, msd, prepare, spatial, training
from trackspark.plans.fixtures import locs

SCHEMA = "cell_id int, mol_id long, frame int, x_px double, y_px double, class_label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


TRACK = [(1, 1, 1, 0.0, 0.0, 1), (1, 1, 2, 3.0, 4.0, 1), (1, 1, 4, 3.0, 4.0, 2), (1, 1, 5, 6.0, 8.0, 2)]


def test_steps_and_gaps(spark):
    rows = features.step_size(features.time_step(frame(spark, TRACK))).orderBy("frame").collect()
    assert [r.step_nm for r in rows] == [0.0, 480.0, 0.0, 480.0]
    assert [round(r.time_step, 3) for r in rows] == [0.0, 0.2, 0.4, 0.2]


def test_one_row_track_has_defined_features(spark):
    names = [n for n in features.REGISTRY if n not in ("spot_size", "spot_area")]
    r = features.with_features(frame(spark, TRACK[:1]), names).collect()
    assert len(r) == 1 and r[0].step_nm == 0.0 and r[0].alpha is None and r[0].efficiency == 0.0


def test_msd_by_hand(spark):
    got = {r.lag: (r.sum_sq, r.n) for r in msd.msd(frame(spark, TRACK)).collect()}
    assert got == {1: (50.0, 2), 2: (0.0, 1), 3: (50.0, 2), 4: (100.0, 1)}


def test_bounded_msd_is_the_full_one(spark, sf):
    d = locs(spark, sf)
    full = {(r.mol_id, r.lag): round(r.sum_sq, 6) for r in msd.msd(d).where("lag <= 6").collect()}
    assert full == {(r.mol_id, r.lag): round(r.sum_sq, 6) for r in msd.msd(d, 6).collect()}


def test_rigid_motion_changes_nothing(spark, sf):
    d = locs(spark, sf)
    moved = spatial.rotate(d, 37.0).select("cell_id", "mol_id", "frame", (F.col("x_rot") + 5).alias("x_px"), (F.col("y_rot") - 3).alias("y_px"))
    a = {(r.mol_id, r.frame): r.efficiency for r in features.efficiency(d).collect()}
    b = {(r.mol_id, r.frame): r.efficiency for r in features.efficiency(moved).collect()}
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_state_times_and_transitions_add_up(spark, sf):
    d = locs(spark, sf)
    assert math.isclose(sum(r.time for r in kinetics.state_times(d).collect()), d.count() / 5.0)
    runs = sum(r.runs for r in msd.runs_by_class(d).collect())
    tracks = d.select("cell_id", "mol_id").distinct().count()
    assert sum(r.n for r in kinetics.transitions(d).collect()) == runs - tracks


def test_strict_events(spark):
    rows = [(1, 1, f, 0.0, 0.0, c) for f, c in ((1, 1), (3, 2), (4, 1), (5, 2))]
    plain = kinetics.events(frame(spark, rows)).orderBy("first_frame").collect()
    assert [round(r.duration, 3) for r in plain] == [0.2] * 4 and plain[-1].right_truncated
    strict = kinetics.events(frame(spark, rows), strict=True).orderBy("first_frame").collect()
    assert [round(r.duration, 3) for r in strict] == [0.4] * 3


def test_conflicts_by_definition(spark):
    import random

    rnd = random.Random(3)
    tracks = {(c, m): sorted(rnd.sample(range(40), rnd.randint(1, 6))) for c in range(3) for m in range(8)}
    d = frame(spark, [(c, m, f, 0.0, 0.0, 1) for (c, m), fs in tracks.items() for f in fs])
    for b in (0, 2):
        want = {k for k, fs in tracks.items() for o, gs in tracks.items() if o != k and o[0] == k[0] and any(gs[0] - b < e < gs[-1] + b for e in (fs[0], fs[-1]))}
        assert {tuple(r) for r in prepare.conflicts(d, b).collect()} == want


def test_consensus_ties_go_to_the_lower_class(spark):
    s = spark.createDataFrame([(1, 1, 1, 0, 2, 0.5), (1, 1, 1, 0, 1, 0.5)], "cell_id int, mol_id long, start int, offset int, class int, p double")
    r = annotate.consensus(s).collect()[0]
    assert (r.label, r.confidence, r.windows) == (1, 0.5, 1)


def test_linking_by_hand(spark):
    rows = [(1, 0, f, x, 0.0, 0) for f, x in ((1, 0.0), (1, 10.0), (2, 1.0), (2, 12.0), (4, 2.0), (9, 2.0))]
    got = {(r.frame, r.x_px): r.mol_id for r in spatial.link_tracks(frame(spark, rows), 1, 3.0).collect()}
    assert got == {(1, 0.0): 1, (1, 10.0): 2, (2, 1.0): 1, (2, 12.0): 2, (4, 2.0): 1, (9, 2.0): 3}


def test_inside_a_square(spark):
    poly = F.array(*[spatial.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    d = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (2.0, 3.9)], "x double, y double")
    p = spatial.point(F.col("x"), F.col("y"))
    got = d.select(spatial.inside(p, spatial.edges(poly)).alias("i"), F.round(spatial.outline_distance(p, spatial.edges(poly)), 6).alias("d")).collect()
    assert [(r.i, r.d) for r in got] == [(True, 1.0), (False, 1.0), (True, 0.1)]


def test_splits_keep_tracks_whole(spark, sf):
    s = training.split(locs(spark, sf), {"train": 0.5, "test": 0.5}, 1)
    assert s.groupBy("cell_id", "mol_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_smoothers_keep_a_line(spark):
    rows = [(1, 1, f, f * f / 2.0, 0.0, 1) for f in range(1, 10)]
    for m in ("lowess", "loess", "sgolay", "rlowess"):
        d = features.smoothed_steps(frame(spark, rows), m).orderBy("frame").collect()
        steps = features.step_size(frame(spark, rows)).orderBy("frame").collect()
        assert all(math.isclose(a.smoothed_nm, b.step_nm, abs_tol=1e-6) for a, b in zip(d, steps, strict=True))


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        features.keep_columns(frame(spark, TRACK), ["nothing"])


def test_empty_table(spark):
    d = frame(spark, [])
    assert features.step_size(d).count() == 0 and msd.msd(d, 3).count() == 0 and kinetics.transitions(d).count() == 0
