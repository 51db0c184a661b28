"""Forests, windows and permutations against plain versions; every row is scored."""

import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import features, msd, stats, training
from trackspark.plans.fixtures import locs
from trackspark.plans.registry import QUERIES
from trackspark.sources import readers, writers

ROW = "cell_id int, mol_id long, frame int, a double, b double, class_label int"


def rows_of(n, seed=0):
    rnd = np.random.default_rng(seed)
    a, b = rnd.random(n), rnd.random(n)
    return [(1, i // 10, i % 10, float(a[i]), float(b[i]), int(1 + (a[i] > 0.4) + (a[i] > 0.8))) for i in range(n)]


def test_rows_with_missing_features_are_scored(spark, tmp_path):
    full = rows_of(400)
    holes = [(c, m, f, None if f == 1 else a, float("nan") if f == 2 else b, k) for c, m, f, a, b, k in full]
    df = spark.createDataFrame(holes, ROW)
    model = training.train_forest(df, ["a", "b"], trees=5)
    got = training.score_forest(model, df)
    assert got.columns == [*df.columns, "pred", "p"] and got.count() == 400 and got.where("pred IS NULL OR p IS NULL").count() == 0
    writers.save_model(model, f"{tmp_path}/m", {"features": ["a", "b"]})
    back, _ = writers.load_model(spark, f"{tmp_path}/m")
    assert sorted(map(str, training.score_forest(back, df).collect())) == sorted(map(str, got.collect()))
    # a missing value counts as the mean over training rows
    mean = statistics.fmean(r[3] for r in holes if r[3] is not None)
    one = lambda a: training.score_forest(model, spark.createDataFrame([(1, 1, 1, a, 0.5, 1)], ROW)).first().p
    assert one(None) == one(mean)


def test_bags_are_poisson(spark):
    d = spark.range(40_000).select(training.bag(3, 7, ["id"]).alias("n"), training.bag(4, 7, ["id"]).alias("m"))
    got = {r.n: r["count"] / 40_000 for r in d.groupBy("n").count().collect()}
    assert abs(got[0] - 0.3679) < 0.01 and abs(got[1] - 0.3679) < 0.01 and abs(got[2] - 0.1839) < 0.01 and abs(got[3] - 0.0613) < 0.01
    assert abs(d.where("n = 0 AND m = 0").count() / 40_000 - 0.1353) < 0.01


def digest(seed, *by):
    return hashlib.md5("|".join(map(str, (seed, *by))).encode()).hexdigest()


def dealt(rows, column, seed):
    """rows (sorted by key) with a column dealt over all of them, the rule of shuffled()."""
    mine = sorted(rows, key=lambda r: r[:3])
    theirs = sorted(rows, key=lambda r: (digest(seed, *r[:3]), r[:3]))
    return [(*r[:column], t[column], *r[column + 1 :]) for r, t in zip(mine, theirs, strict=True)]


def test_out_of_bag_importance_is_the_plain_one(spark):
    rows = rows_of(300, 4)
    df = spark.createDataFrame(rows, ROW).repartition(3)
    order = ("cell_id", "mol_id", "frame")
    got = {r.feature: (r.importance, r.increase, r["rank"]) for r in training.out_of_bag_importance(df, ["a", "b"], trees=5, depth=4, seed=2).collect()}
    models, held = training.train_bagged(df, ["a", "b"], trees=5, depth=4, seed=2)
    left = {t: {(r.mol_id, r.frame) for r in held.where(training.bag(t, 2, order) == 0).collect()} for t in range(5)}
    assert all(60 < len(v) < 160 for v in left.values())

    def errors(data):
        d = spark.createDataFrame(data, ROW)
        for t, m in enumerate(models):
            d = m.transform(d).select(*d.columns, f"_p{t}")
        found = d.collect()
        return [statistics.fmean(float(r[f"_p{t}"] + 1 != r.class_label) for r in found if (r.mol_id, r.frame) in left[t]) for t in range(5)]

    base = errors(rows)
    for k, f in enumerate(["a", "b"]):
        more = [x - y for x, y in zip(errors(dealt(rows, 3 + k, 2 + k)), base, strict=True)]
        assert got[f][1] == pytest.approx(statistics.fmean(more)) and got[f][0] == pytest.approx(statistics.fmean(more) / statistics.stdev(more))
    assert got["a"][2] == 1 and got["a"][1] > 0.2 > abs(got["b"][1])


def test_a_feature_is_dealt_over_all_rows(spark):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, ROW).repartition(5)
    got = stats.shuffled(df, "b", 9, ["cell_id", "mol_id", "frame"])
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(dealt(rows, 4, 9))
    moved = [abs(a[1] - b[1]) for a, b in zip(sorted(rows, key=lambda r: r[4]), sorted(map(tuple, got.collect()), key=lambda r: r[4]), strict=True)]
    assert statistics.fmean(moved) > 10  # far over all tracks, not among neighbours
    assert stats.shuffled(df.limit(0), "b", 1, ["mol_id"]).count() == 0


def test_trained_windows_beat_the_rule(spark, sf):
    """From L-08 to A-09: trained, saved, loaded, scored by consensus, on tracks that the training didn't see."""
    got = QUERIES["L-14-trained"](spark, sf)
    truth = features.step_size(locs(spark, sf)).withColumn("row", F.row_number().over(features.track()))
    both = truth.join(got, ["cell_id", "mol_id", "row"])
    rule = F.when(F.col("step_nm") < 30, 1).when(F.col("step_nm") < 90, 2).otherwise(3)
    ours, plain, n = both.agg(F.avg((F.col("label") == F.col("class_label")).cast("double")), F.avg((rule == F.col("class_label")).cast("double")), F.count("*")).first()
    # every row of a held-out track of at least a window has its label
    test = training.split(locs(spark, sf), {"train": 0.7, "test": 0.3}, 5).where("split = 'test'").groupBy("cell_id", "mol_id").agg(F.count("*").alias("n"))
    assert n == test.where("n >= 20").agg(F.sum("n")).first()[0] and ours > plain


def test_positions_of_windows(spark):
    d = spark.createDataFrame([(1, 1, f, float(f), f % 2 + 1) for f in range(1, 6)], "cell_id int, mol_id long, frame int, v double, class_label int")
    got = {(r.start, r.offset): (list(r._x.toArray()), r.y) for r in training.positions(d, ["v"], 4, 1, "class_label").collect()}
    assert len(got) == 8 and got[1, 0] == ([0.0, 1.0, 2.0], 2) and got[2, 3] == ([4.0, 5.0, 0.0], 2) and got[2, 1] == ([2.0, 3.0, 4.0], 2)


def test_tracks_are_padded_by_class_of_length(spark):
    n = {1: 1, 2: 3, 3: 4, 4: 5, 5: 700, 6: 9}
    d = spark.createDataFrame([(1, m, f, float(m)) for m, k in n.items() for f in range(k)], "cell_id int, mol_id long, frame int, v double").coalesce(1)

    def widths(x):
        return [[len(t)] * len(t) for t in x]

    got = training.score_tracks(d, ["v"], None, widths).collect()
    assert sorted((r.mol_id, r["row"]) for r in got) == [(m, i + 1) for m, k in n.items() for i in range(k)]
    assert {r.mol_id: r.label for r in got}[5] == 700 and all(r.label < 2 * n[r.mol_id] for r in got)
    cut = training.score_tracks(d, ["v"], 4, widths).collect()
    assert sorted((r.mol_id, r["row"]) for r in cut) == [(m, i + 1) for m, k in n.items() for i in range(min(4, k))] and {r.label for r in cut} == {4}


@pytest.mark.parametrize("method", features.SMOOTHERS)
def test_even_widths(spark, method):
    d = spark.createDataFrame([(1, 1, f, (f - 1) * 50.0 + (f % 3) * 7, 0.0) for f in range(1, 12)], "cell_id int, mol_id long, frame int, x_px double, y_px double")
    step = [r.step_nm for r in features.step_size(d).orderBy("frame").collect()]
    for width in (1, 2, 4, 6):
        got = [r.smoothed_nm for r in features.smoothed_steps(d, method, width).orderBy("frame").collect()]
        assert len(got) == 11 and got[0] == 0 and all(v is not None for v in got)
        if method in ("movmean", "movmedian"):
            of = statistics.fmean if method == "movmean" else statistics.median
            assert got[1:] == pytest.approx([of(step[max(1, i - width // 2) : i + (width - 1) // 2 + 1]) for i in range(1, 11)])
    with pytest.raises(ValueError):
        features.smoothed_steps(d, method, 0)


def test_residuals_of_a_fitted_mixture(spark):
    rnd = np.random.default_rng(1)
    d = spark.createDataFrame([(float(v),) for v in [*rnd.gamma(4, 0.1 / 4, 3000), *rnd.gamma(4, 2.0 / 4, 1000)]], "d double")
    fit = msd.gamma_mixture(d, 2, 4.0)
    got = msd.mixture_residuals(d, fit, 4.0, 0.1).collect()
    assert sorted(r.bin for r in got) == list(range(len(got))) and sum(r.n for r in got) == 4000
    assert sum(r.fit for r in got) == pytest.approx(4000, rel=0.1) and max(abs(r.residual) for r in got if r.bin > 3) < 60
    assert msd.mixture_residuals(d.limit(0), fit, 4.0, 0.1).count() == 0


def test_frames_are_found_without_nested_loops(spark):
    videos = spark.createDataFrame([(0, 3), (1, 0), (2, 500), (3, 1), (4, 40)], "file_idx int, n_frames int")
    frames = spark.createDataFrame([(f, f) for f in range(-3, 560)], "k int, frame int")
    got = readers.find_frame(frames, videos)
    ends, want = [(0, 0, 3), (2, 3, 500), (3, 503, 1), (4, 504, 40)], []
    for f in range(-3, 560):
        want += [(f, f, i, f - o) for i, o, n in ends if o < f <= o + n]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_cells_without_tracks_go(spark, sf):
    assert sorted(r.cell_id for r in QUERIES["F-08"](spark, sf).collect()) == [0, 1, 3, 4, 6]


def test_bounded_msd_is_one_sorted_pass(spark, sf):
    d = locs(spark, sf)
    rows = [(1, 1, f, float(f * f % 7), 0.0) for f in (1, 2, 2, 5, 6)] + [(None, 1, 1, 0.0, 0.0), (None, 1, 2, 0.0, 0.0)]
    twice = spark.createDataFrame(rows, "cell_id int, mol_id long, frame int, x_px double, y_px double")
    for df in (d, twice):
        full = {(r.cell_id, r.mol_id, r.lag): (round(r.sum_sq, 6), r.n) for r in msd.msd(df).where("lag <= 4").collect()}
        assert full == {(r.cell_id, r.mol_id, r.lag): (round(r.sum_sq, 6), r.n) for r in msd.msd(df, 4).collect()}
    plan = lambda x: x._jdf.queryExecution().sparkPlan().toString() + x._jdf.queryExecution().executedPlan().toString()
    spread = spark.createDataFrame(rows, twice.schema)
    assert plan(msd.msd(spread, 4)).count("Exchange") == 1 and "Join" not in plan(msd.msd(spread, 4))
    assert plan(msd.track_diffusion(spread, 4)).count("Join") <= 2


def test_points_meet_outlines_by_broadcast_and_by_join(spark, sf):
    from trackspark.operators import spatial
    from trackspark.plans.space_queries import points, shifted

    p, c = points(spark, sf).select("id", "x_px", "y_px"), shifted(spark, sf)
    odd = p.unionByName(spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 20.0, 20.0)], "id long, x_px double, y_px double"))
    rows = lambda d: sorted((r.id, r.cell_id, round(r.depth, 6)) for r in d.collect())
    held = spatial.in_boxes(odd, c)
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    want = rows(held)
    assert want and any(i == 3 for i, _, _ in want)
    assert rows(spatial.in_boxes(odd, c, most=0)) == want == rows(spatial.in_boxes(odd, c, most=0, tile_rows=50)) == rows(spatial.in_boxes(odd, c, tile=3.0))
    assert spatial.in_boxes(odd.limit(0), c).count() == 0 == spatial.in_boxes(odd, c.limit(0)).count()


def test_no_tile_is_a_hot_key(spark):
    from trackspark.operators import spatial

    p = spark.range(5000).select(F.col("id"), (F.rand(1) * 10).alias("x_px"), (F.rand(2) * 10).alias("y_px"))
    box = spark.createDataFrame([(1, 0.0, 20.0, 0.0, 20.0, [0.0] * 4)], "cell_id int, x_min double, x_max double, y_min double, y_max double, _f array<double>")
    j = spatial.dealt_tiles(p, box, 64.0, 100)
    assert j.count() == 5000 and j.groupBy("_tx", "_ty", "_part").count().agg(F.max("count")).first()[0] < 160


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from trackspark.functions import storage

    def session(warehouse, checkpoint=None):
        kept = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoint}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kept.get(k) or d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))

    assert storage.shared_dir(session("hdfs://x/warehouse")).startswith("hdfs://x/warehouse/_shared/")
    assert storage.shared_dir(session("file:/a", "s3a://b/c")).startswith("s3a://b/c/")
    for local in ("file:/home/warehouse", "/home/warehouse"):
        with pytest.raises(ValueError, match="all executors see"):
            storage.shared_dir(session(local))
