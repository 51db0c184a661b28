"""Nothing is cut: long tracks, rows in the caps."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_oracle import TABLES, rows
from trackspark.operators import spatial, training
from trackspark.plans.registry import ORACLE, QUERIES


def longer(s, d, n):
    """The tables with one user of n events more."""
    events = s.read.parquet(f"{d}/events.parquet")
    top = events.agg(F.max("event_id"), F.max("user_id"), F.min("ts")).first()
    kinds = {f.name: f.dataType for f in events.schema.fields}
    new = s.range(1, n + 1).select((F.col("id") + top[0]).alias("event_id"), F.lit(top[1] + 1).alias("user_id"), (F.lit(top[2]) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), (F.col("id") % 50 + 0.5).alias("value"))
    new = new.select(*[F.col(c).cast(t).alias(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    return events.unionByName(new)


@pytest.fixture(scope="module")
def long_tables(spark, sf, tmp_path_factory):
    """The smallest tables with a track of 230 rows, and DuckDB on them."""
    d, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    for t in TABLES:
        x = longer(spark, sf, 230) if t == "events" else spark.read.parquet(f"{sf}/{t}.parquet")
        x.coalesce(1).write.parquet(f"{d}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("key", ["L-05", "L-15", "L-15b"])
def test_long_tracks_equal_sql(spark, long_tables, key):
    d, con = long_tables
    got, c = QUERIES[key](spark, d), con.execute(ORACLE[key])
    columns = [x[0] for x in c.description]
    found = [tuple(r) for r in got.collect()]
    assert max(r[got.columns.index("row")] for r in found) == 230
    assert rows(got.columns, found) == rows(columns, c.fetchall())


def test_padding_is_to_the_longest_track(spark):
    d = spark.createDataFrame([(1, m, f, 1.0, 1) for m, n in ((1, 3), (2, 130)) for f in range(n)], "cell_id int, mol_id long, frame int, v double, class_label int")
    got = {r.mol_id: (len(r.x), len(r.y), sum(r["mask"])) for r in training.padded(d, ["v"]).collect()}
    assert got == {1: (130, 130, 3), 2: (130, 130, 130)}


@pytest.mark.parametrize(("key", "column"), [("K-01", "traj_idx"), ("A-12", "label"), ("A-12-thresholds", "label")])
def test_the_cap_is_200_rows(spark, long_tables, key, column):
    d, con = long_tables
    got, c = QUERIES[key](spark, d), con.execute(ORACLE[key])
    columns = [x[0] for x in c.description]
    found = [tuple(r) for r in got.collect()]
    assert rows(got.columns, found) == rows(columns, c.fetchall())
    events = con.execute("SELECT count(*) FROM events").fetchone()[0]
    assert sum(r[got.columns.index(column)] is not None for r in found) == events - 30


def test_cell_coordinates_of_a_straight_cell(spark):
    """Inside, in the caps and beyond the poles of a cell whose middle line runs along y = 20 from x = 2 to 42."""
    rows = [(1, i, 2.0 + 4 * i, 20.0 + h, 2.0 + 4 * i, 20.0 - h) for i, h in enumerate([0, 6, *[9] * 7, 6, 0])]
    mesh = spark.createDataFrame(rows, "cell_id int, i int, xl double, yl double, xr double, yr double")
    cell = mesh.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "xl", "yl", "xr", "yr"))).alias("mesh"))
    points = [(x, y) for x in (-7.5, 1.0, 2.0, 7.0, 21.5, 42.0, 42.25, 60.0) for y in (11.0, 19.5, 20.0, 20.5, 27.0)]
    d = spark.createDataFrame([(1, i, 1, x, y) for i, (x, y) in enumerate(points)] + [(1, 99, 1, None, 1.0), (1, 98, 1, float("nan"), 1.0)], "cell_id int, mol_id int, frame int, x_px double, y_px double")
    got = {r.mol_id: r for r in spatial.cell_coordinates(d, cell).collect()}
    assert len(got) == len(points) + 2 and got[99].longitude is None and got[98].side is None
    for i, (x, y) in enumerate(points):
        r = got[i]
        if 2 < x < 42:
            half = np.interp(x, [2, 6, 10, 34, 38, 42], [0, 6, 9, 9, 6, 0])
            want = ((x - 2) / 40 - 0.5, x - 22, (y - 20) / half / 2, y - 20)
        else:
            # past a pole the line goes straight on; the half width is that at the middle of the last segment before the first pole; past the far one, whose
            # ends the reference swaps, the mean of the two diagonals
            off = abs(y - 20) if to_arm(x, y, 1) < to_arm(x, y, -1) else -abs(y - 20)
            want = ((x - 22) / 40, x - 22, off / (3 if x <= 2 else (math.hypot(4, 6) + 4) / 2) / 2, off)
        assert [r.longitude, r.longitude_px, r.latitude, r.latitude_px] == pytest.approx(want, abs=1e-6)
        assert r.beyond == (x <= 2 or x >= 42 and not (x == 42 and y == 20)) and (r.side == 1) == (r.latitude_px > 0 or r.latitude_px == 0 and r.side == 1)


ARM = [(2, 20), (6, 26), *[(x, 29) for x in range(10, 38, 4)], (38, 26), (42, 20)]


def to_arm(x, y, side):
    """Distance to an arm of the outline; side -1 is the right one, the left one's mirror image."""
    best = math.inf
    for (ax, ay), (bx, by) in itertools.pairwise((px, 20 + side * (py - 20)) for px, py in ARM):
        ux, uy = bx - ax, by - ay
        t = max(0, min(1, ((x - ax) * ux + (y - ay) * uy) / (ux * ux + uy * uy)))
        best = min(best, math.hypot(x - ax - t * ux, y - ay - t * uy))
    return best
