"""Small tracks with numbers worked out by hand, for the rules that the SQL could share a mistake with."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.ranks import numbered, quantiles, running
from trackspark.operators import annotate, features, maps, msd, spatial, stats, training
from trackspark.params import DEFAULT

SCHEMA = "cell_id int, mol_id long, frame int, x_px double, y_px double, class_label int"


def table(spark, *tracks):
    """Tracks of (frame, x, y) or (frame, x, y, label)."""
    return spark.createDataFrame([(1, m, r[0], float(r[1]), float(r[2]), r[3] if len(r) > 3 else 1) for m, t in enumerate(tracks) for r in t], SCHEMA)


def column(df, name, mol=0):
    return [r[name] for r in df.where(F.col("mol_id") == mol).orderBy("frame").collect()]


#: Five rows, a gap of ten frames, three rows.
GAPPED = [(1, 0, 0), (2, 1, 0), (3, 2, 1), (4, 2, 3), (5, 5, 3), (15, 6, 3), (16, 6, 4), (17, 9, 4)]


def test_two_rows_are_needed_on_both_sides(spark):
    d = table(spark, GAPPED, [(1, 0, 0)], [(1, 0, 0), (2, 1, 1)])
    for make, names in ((features.rolling_position_std, ("pos_std_ratio", "pos_std_delta", "pos_std_abs")), (features.rolling_dispersion, ("disp_ratio", "disp_delta", "disp_abs")), (features.centroid_shift, ("centroid_nm",))):
        out = make(d)
        for n in names:
            got = column(out, n)
            # rows 3 and 4 have two rows before and after; row 5 has itself only ahead, row 6 nothing behind, row 7 one; row 8 is the last
            assert [v != 0 for v in got] == [False, False, True, True, False, False, False, False]
            assert column(out, n, 1) == [0.0] and column(out, n, 2) == [0.0, 0.0]
    ahead, behind = np.array([[2, 1], [2, 3], [5, 3]]), np.array([[0, 0], [1, 0]])
    far = np.hypot(*(ahead.mean(axis=0) - behind.mean(axis=0))) * DEFAULT.px_scale
    assert column(features.centroid_shift(d), "centroid_nm")[2] == pytest.approx(far)
    spread = lambda p: np.hypot(*(p - p.mean(axis=0)).T).mean() * DEFAULT.px_scale
    assert column(features.rolling_dispersion(d), "disp_delta")[2] == pytest.approx(spread(ahead) - spread(behind))
    assert column(features.rolling_dispersion(d), "disp_abs")[2] == pytest.approx(abs(spread(ahead) - spread(behind)))
    std = lambda p: p.std(axis=0, ddof=1).mean() * DEFAULT.px_scale
    assert column(features.rolling_position_std(d), "pos_std_ratio")[2] == pytest.approx(std(ahead) / std(behind))


def test_trappedness_takes_one_frame_interval(spark):
    d = table(spark, GAPPED, [(1, 0, 0), (3, 1, 0), (5, 2, 2)], [(1, 0, 0), (2, 1, 0)], [(1, 3, 3), (2, 3, 3), (3, 3, 3)])
    p = np.array([[0, 0], [1, 0], [2, 1], [2, 3], [5, 3]]) * DEFAULT.px_scale / 1000
    one, two = (np.mean(((p[k:] - p[:-k]) ** 2).sum(axis=1)) for k in (1, 2))
    diffusion = (two - one) / 4 * DEFAULT.frame_rate
    radius = max(math.dist(a, b) for a in p for b in p) / 2
    want = 1 - math.exp(0.2048 - 0.25117 * diffusion / DEFAULT.frame_rate / radius**2)
    out = features.trappedness(d)
    assert column(out, "trapped")[:5] == pytest.approx([want] * 5)
    assert column(out, "trapped", 1) == [0.0] * 3  # no pair one frame apart
    assert column(out, "trapped", 2) == [0.0] * 2 and column(out, "trapped", 3) == [0.0] * 3


def test_empty_lags_count_as_zero_in_a_tracks_diffusion(spark):
    d = table(spark, [(f, f * f / 10, 0) for f in (1, 2, 3, 8, 9)], [(f * 10, f, f) for f in range(6)], [(f, f, f) for f in range(4)])
    got = {r.mol_id: r.d for r in msd.track_diffusion(d, 4).collect()}
    x = {f: f * f / 10 for f in (1, 2, 3, 8, 9)}
    means = [np.mean([(x[a] - x[b]) ** 2 for a in x for b in x if b - a == k]) for k in (1, 2)]
    means += [0.0, 0.0]  # no rows are three or four frames apart
    slope = np.polyfit(np.arange(1, 5) / DEFAULT.frame_rate, np.array(means) * (DEFAULT.px_scale / 1000) ** 2, 1)[0]
    assert set(got) == {0, 1} and got[0] == pytest.approx(slope / 4) and got[1] == 0.0


def test_turns_after_standing_still(spark):
    d = table(spark, [(1, 0, 0), (2, 0, 0), (3, 0, 2), (4, 0, 2), (5, -1, 2)])
    # after a step without length the turn is the angle to the x axis, and a step without length has none
    assert column(features.turn_angle(d), "turn_angle") == pytest.approx([0, 0, 90, 0, 180])


@pytest.mark.parametrize("method", ["lowess", "loess", "sgolay", "rlowess", "rloess"])
def test_local_fits(spark, method):
    rng = np.random.default_rng(4)
    tracks = [[(f, *rng.normal(size=2).cumsum()) for f in range(n)] for n in (1, 2, 3, 4, 9, 30)]
    tracks = [[(f, x * 5, y * 7) for f, x, y in t] for t in tracks]
    out = features.smoothed_steps(table(spark, *tracks), method)
    for m, t in enumerate(tracks):
        xy = np.array([r[1:] for r in t])
        y = np.hypot(*np.diff(xy, axis=0).T) * DEFAULT.px_scale if len(t) > 1 else np.empty(0)
        fit, robust = y.copy(), np.ones(len(y))
        for _ in range(5 if method[0] == "r" else 1):
            for i in range(len(y)):
                j = np.arange(max(0, i - 2), min(len(y), i + 3))
                far = np.abs(j - i)
                k = (np.ones(len(j)) if method == "sgolay" else (1 - (far / (far.max() + 1)) ** 3) ** 3) * robust[j]
                n = min(1 if method.endswith("lowess") else 2, int((k > 0).sum()) - 1)
                fit[i] = np.polyfit(j - i, y[j], n, w=np.sqrt(k))[-1] if n >= 0 else y[i]
            six = 6 * np.median(np.abs(y - fit)) if len(y) else 0
            if six > 0:
                robust = np.where(np.abs(y - fit) < six, (1 - ((y - fit) / six) ** 2) ** 2, 0)
        assert column(out, "smoothed_nm", m) == pytest.approx([0.0, *fit], rel=1e-6, abs=1e-6)


def test_agreement_goes_by_position(spark):
    human = table(spark, [(f, 0, 0, c) for f, c in zip((1, 2, 5, 6), (1, 1, 2, 2), strict=True)])
    model = table(spark, [(f, 0, 0, c) for f, c in zip((11, 12, 13), (1, 2, 1), strict=True)])
    r = annotate.two_class_agreement(human, model).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (1, 0, 1, 1) and r.precision == r.recall == r.f1 == 0.5 and r.accuracy == pytest.approx(1 / 3)


def test_links_at_ties(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 0, 2.0, 0.0), (1, 1, 1.0, 0.0), (1, 4, 1.0, 0.0), (1, 2, 1.5, 0.0)]
    d = spark.createDataFrame(rows, "cell_id int, frame int, x_px double, y_px double")
    got = {(r.frame, r.x_px): r.mol_id for r in spatial.link_tracks(d, mem=0, dist=3.0).collect()}
    # the point between two tracks goes to the first; with no memory the track ends where a frame is missing
    assert got == {(0, 0.0): 1, (0, 2.0): 2, (1, 1.0): 1, (2, 1.5): 1, (4, 1.0): 3}


def test_running_sums_and_quantiles_of_large_keys(spark):
    d = spark.range(3000).select((F.col("id") % 3).cast("int").alias("k"), (F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("one")).where("k < 2").repartition(5)
    got = running(d.groupBy("k", "v").agg(F.count("*").alias("n")), ["k"], ["v"], {"c": "n"}).collect()
    rows = d.collect()
    for r in got[::37]:
        assert r.c == sum(1 for x in rows if x.k == r.k and x.v <= r.v)
    values = {k: np.array([x.v for x in rows if x.k == k], float) for k in (0, 1)}
    for r in quantiles(d, ["k"], "v", [0, 0.1, 0.5, 0.77, 1]).collect():
        assert r.v == pytest.approx(np.quantile(values[r.k], r.share))
    assert sorted(r.n for r in numbered(d.select("k", "v").distinct(), ["k"], ["v"], "n").where("k = 0").collect()) == list(range(1, len(set(values[0])) + 1))


def test_windows_are_summed_within_tracks(spark):
    d = table(spark, [(f, f % 7, 0) for f in range(30)], [(f, f % 3, 0) for f in range(9)], [(f * 2, f % 5, 0) for f in range(12)])

    def scorer(x):
        return [[[v[0] * (i + 1), 2.0, -v[0]] for i, v in enumerate(w)] for w in x]

    got = {(r.mol_id, r.row): r for r in training.score_windows(d, ["x_px"], 10, scorer, 3).collect()}
    for m, n, mod in ((0, 30, 7), (2, 12, 5)):
        sums, seen = np.zeros((n, 3)), np.zeros(n)
        for a in range(n - 9):
            s = np.array(scorer([[[float((a + i) % mod)] for i in range(10)]])[0])
            e = np.exp(s - s.max(axis=1, keepdims=True))
            sums[a : a + 10] += e / e.sum(axis=1, keepdims=True)
            seen[a : a + 10] += 1
        for i in range(n):
            r = got[m, i + 1]
            assert r.label == sums[i].argmax() + 1 and r.windows == seen[i] and r.confidence == pytest.approx(sums[i].max() / sums[i].sum())
    assert not any(m == 1 for m, _ in got)


def test_regions_around_changes(spark):
    d = table(spark, [(f, f, 0, c) for f, c in enumerate([1, 1, 1, 2, 2, 2, 2, 1, 3, 3])])
    near = stats.regions(d, 1, 2, 2, "proximal").select("class", "x_px").collect()
    assert sorted((r["class"], r.x_px) for r in near) == [(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (2, 5.0), (2, 6.0), (2, 7.0), (2, 8.0)]
    assert sorted(r.x_px for r in stats.regions(d, 1, 2, 1, "distal").collect()) == [0.0, 1.0, 4.0, 5.0]


def test_kernel_is_even_and_sums_to_one():
    k = {(dx, dy): w for dx, dy, w in maps.kernel(0.3, 0.15)}
    sd = 0.3 / (2 * math.sqrt(2 * math.log(2)))
    assert sum(k.values()) == pytest.approx(1) and max(dx for dx, _ in k) == math.floor(6 * sd / 0.15)
    assert all(k[dx, dy] == k[-dx, dy] == k[dy, dx] for dx, dy in k)
    assert k[1, 0] / k[0, 0] == pytest.approx(math.exp(-(0.15**2) / (2 * sd * sd)))


def test_forests_learn_a_feature_that_tells_classes_apart(spark):
    rng = np.random.default_rng(7)
    rows = [(1, m, f, float(c * 10 + rng.normal()), float(rng.normal()), c) for m in range(24) for f in range(12) for c in [1 + (f // 4 + m) % 3]]
    d = spark.createDataFrame(rows, SCHEMA)
    model = training.train_forest(d.where("mol_id < 16"), ["x_px", "y_px"], trees=8)
    out = training.score_forest(model, d.where("mol_id >= 16"))
    assert out.where("pred = class_label").count() >= 0.9 * out.count() and out.where("p < 0.3 OR p > 1").count() == 0
    got = {r.metric: r["mean"] for r in training.cross_validate(d, ["x_px", "y_px"], 2, trees=5).collect()}
    assert set(got) == {"accuracy", "precision", "recall", "f1"} and min(got.values()) > 0.9

    def score(t):
        return stats.masked_accuracy(t.withColumn("g", F.greatest(F.lit(1), F.least(F.lit(3), F.round(F.col("x_px") / 10).cast("int")))), "class_label", "g")

    lost = {r.feature: (r.importance, r["rank"]) for r in stats.permutation_importance(d, ["y_px", "x_px"], score, 2).collect()}
    assert lost["x_px"][0] > 0.4 and lost["x_px"][1] == 1 and lost["y_px"] == (0.0, 2)
