"""Linking in pieces and by event time gives the tracks of one pass over a cell, and arrivals those of the tables."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.functions.components import components
from trackspark.operators import spatial
from trackspark.plans import table_queries
from trackspark.plans.registry import QUERIES
from trackspark.streaming import online


def plain(points, mem, dist):
    """(frame, x, y, id) of one cell: every point against every open track."""
    open_, next_id, out = [], 1, []
    for frame in sorted({p[0] for p in points}):
        here = sorted(p[1:] for p in points if p[0] == frame)
        open_ = [t for t in open_ if frame - t[3] <= mem + 1]
        pairs = sorted((((x - t[1]) ** 2 + (y - t[2]) ** 2) ** 0.5, k, j) for k, (x, y) in enumerate(here) for j, t in enumerate(open_))
        ids, taken = {}, set()
        for d, k, j in pairs:
            if d <= dist and k not in ids and j not in taken:
                taken.add(j)
                ids[k] = open_[j][0]
                open_[j] = [open_[j][0], *here[k], frame]
        for k, p in enumerate(here):
            if k not in ids:
                ids[k] = next_id
                open_.append([next_id, *p, frame])
                next_id += 1
        out += [(frame, *p, ids[k]) for k, p in enumerate(here)]
    return sorted(out)


def clouds(seed, cells=3, n=250, wide=60):
    """Points on a coarse lattice, so that distances tie, in each cell."""
    rnd = random.Random(seed)
    return {c: list({(rnd.randrange(40), rnd.randrange(wide * (c + 1)) / 2, rnd.randrange(wide) / 2) for _ in range(n)}) for c in range(cells)}


@pytest.mark.parametrize(("mem", "dist"), [(1, 3.0), (0, 1.5), (3, 2.0), (1, 0.0)])
def test_pieces_give_the_tracks_of_one_pass(spark, mem, dist):
    data = clouds(5)
    df = spark.createDataFrame([(c, *p, "x") for c, ps in data.items() for p in ps], "cell_id int, frame int, x_px double, y_px double, note string")
    got = spatial.link_tracks(df, mem, dist)
    assert got.columns == ["cell_id", "frame", "x_px", "y_px", "note", "mol_id"]
    rows = got.collect()
    for c, ps in data.items():
        assert sorted((r.frame, r.x_px, r.y_px, r.mol_id) for r in rows if r.cell_id == c) == plain(ps, mem, dist)


def test_a_cell_falls_into_many_pieces(spark):
    df = spark.createDataFrame([(1, f, 40.0 * k + f % 2, 5.0) for k in range(50) for f in range(20)], "cell_id int, frame int, x_px double, y_px double")
    assert spatial.with_piece(df, 1, 3.0, ["cell_id"]).select("_piece").distinct().count() == 50
    assert spatial.link_tracks(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


POINTS = "cell_id int, frame int, x_px double, y_px double"


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_a_frame_in_two_batches_and_any_order(spark, seed):
    rnd = random.Random(seed)
    data = clouds(seed, 2, 120, 20)
    rows = [(c, *p) for c, ps in data.items() for p in ps]
    parts = [[], [], [], []]
    for r in rows:
        parts[min(3, r[1] // 12 + rnd.randrange(2))].append(r)
    frames = [spark.createDataFrame(p, POINTS).repartition(3) for p in [*parts, [(9, 10_000, 0.0, 0.0)]]]
    out, late = table_queries._fed(spark, frames, POINTS, lambda x: online.link_stream(x, 1, 3.0, delay=30))
    assert late == 0
    got = out.collect()
    for c, ps in data.items():
        own = [r for r in got if r.cell_id == c]
        number = {i: k + 1 for k, i in enumerate(sorted({r.mol_id for r in own}))}
        assert sorted((r.frame, r.x_px, r.y_px, number[r.mol_id]) for r in own) == plain(ps, 1, 3.0)


def test_late_rows_are_counted_and_silent_cells_forgotten(spark, tmp_path):
    feed = [[(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 1.0, 0.0)], [(3, 500, 0.0, 0.0)], [(1, 2, 0.0, 0.0), (3, 501, 0.0, 0.0)], [(3, 900, 0.0, 0.0)]]
    states, late = [], 0
    for part in feed:
        spark.createDataFrame(part, POINTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(POINTS).parquet(f"{tmp_path}/in")
        q = online.link_stream(stream, 1, 3.0, delay=5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        late += online.late_rows(q)
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert late == 1 and states == [2, 1, 1, 1]
    assert sorted((r.cell_id, r.frame, r.mol_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1, 1 << 32), (2, 1, 1 << 32), (2, 2, 1 << 32), (3, 500, 500 << 32), (3, 501, 500 << 32)]


def test_stream_linking_is_batch_linking(spark, sf):
    batch = sorted(tuple(r) for r in QUERIES["G-16"](spark, sf).select("cell_id", "frame", "x_px", "y_px", "mol_id").collect())
    assert sorted(tuple(r) for r in QUERIES["R-01"](spark, sf).collect()) == batch
    locs = sorted((r.cell_id, r.frame, r.x_px, r.y_px) for r in table_queries.locs(spark, sf).collect())
    want = []
    for c in sorted({x[0] for x in locs}):
        want += [(c, *r) for r in plain([x[1:] for x in locs if x[0] == c], table_queries.DEFAULT.mem_param, table_queries.DEFAULT.link_dist)]
    assert batch == sorted(want)


def test_arrivals_of_a_stream(spark, sf):
    want = sorted((r.s.strftime("%Y-%m-%d %H:%M:%S"), r.n) for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.min("ts").alias("f")).groupBy(F.date_trunc("hour", "f").alias("s")).agg(F.count("*").alias("n")).collect())
    assert sorted(tuple(r) for r in QUERIES["R-02"](spark, sf).collect()) == want


def test_a_silent_key_arrives_again(spark):
    rows = lambda *x: spark.createDataFrame([(k, t) for k, t in x], "k long, t long").select("k", F.timestamp_seconds("t").alias("at"))
    out, late = table_queries._fed(spark, [rows((1, 1100), (1, 1050), (2, 1070)), rows((1, 1000), (1, 5000)), rows((9, 90_000))], "k long, at timestamp", lambda x: online.arrivals(x, "k", "at", "200 seconds", "600 seconds"))
    assert late == 0 and sorted((r.k, int(r.arrived.timestamp())) for r in out.collect()) == [(1, 1000), (1, 5000), (2, 1070)]
