"""Rows that only larger tables hold: users of sf0.1 with shifted keys, one by one, against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.columns import rounded
from trackspark.operators import features as E
from trackspark.operators import spatial, stats
from trackspark.plans.registry import ORACLE, QUERIES
from trackspark.streaming import online

BASE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events of these molecules in the tables that hold sf0.1 sixty times: copy k has k * 1500 added to users, k * 100000 to events."""

    def make(mols):
        out = tmp_path_factory.mktemp("shifted")
        parts = [f"SELECT event_id + {m // 1500} * 100000 AS event_id, ts, user_id + {m // 1500} * 1500 AS user_id, event_type, value, props FROM '{BASE}/events.parquet' WHERE user_id = {m % 1500}" for m in mols]
        duckdb.execute(f"COPY ({' UNION ALL '.join(parts)}) TO '{out}/events.parquet' (FORMAT parquet)")
        duckdb.execute(f"COPY (SELECT * FROM '{BASE}/nation.parquet') TO '{out}/nation.parquet' (FORMAT parquet)")
        return str(out)

    return make


def both(spark, d, key):
    """Rows of the query and of its SQL, by the SQL's columns; exactly, not rounded."""
    c = duckdb.connect()
    for t in ("events", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = c.execute(ORACLE[key])
    columns = [x[0] for x in sql.description]
    return sorted(tuple(r) for r in QUERIES[key](spark, d).select(columns).collect()), sorted(sql.fetchall())


@pytest.mark.parametrize("key", ["G-12", "G-13", "G-14"])
def test_points_that_lie_equally_near(spark, folder, key):
    # a point whose nearest place is a pole, on both arms; one equally near to two segments; and one whose latitude is scaled to a half
    got, want = both(spark, folder([14668, 48552, 17569]), key)
    assert got == want


def test_rounding_is_that_of_sql(spark):
    values = [-0.35333749999999997, 0.35333749999999997, 1010213648007430.6, 2.5e-7, -1e-9, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [None if v is None else duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0, round(CAST(? AS DOUBLE), 4) + 0.0", [v, v]).fetchone() for v in values]
    got = [tuple(r) for r in df.select(rounded(F.col("v"), 6), rounded(F.col("v"), 4)).collect()]
    assert got == [(None, None) if w is None else w for w in want]


def test_deviations_of_equal_steps(spark, folder):
    # steps before a row are equal but for rounding, so the ratio is as wide as the rounding is fine
    got, want = both(spark, folder([11131, 18959, 30133, 34381, 41428, 46333, 62117]), "E-22")
    assert got == want


def test_local_diffusion_by_frame_ranges(spark):
    rows = [(1, 1, f, x, 1.0) for f, x in [(1, 0.0), (2, 1.0), (3, None), (4, 4.0), (5, 2.0), (9, 3.0), (30, 1.0)]]
    df = spark.createDataFrame(rows, "cell_id int, mol_id long, frame int, x_px double, y_px double")
    p = E.DEFAULT

    def plain(at):
        near = [r for r in rows if abs(r[2] - at) <= p.w and r[3] is not None]
        v = []
        for lag in range(1, p.w + 1):
            own = [(b[3] - a[3]) ** 2 for a in near for b in near if b[2] - a[2] == lag]
            v.append((lag / p.frame_rate, sum(own) / len(own) * (p.px_scale / 1000) ** 2 if own else 0.0))
        n, st, sv = len(v), sum(t for t, _ in v), sum(q for _, q in v)
        return (n * sum(t * q for t, q in v) - st * sv) / (n * sum(t * t for t, _ in v) - st * st) / 4

    out = E.local_diffusion(df)
    assert out.columns == df.columns + ["local_d"]
    got = {r.frame: r.local_d for r in out.collect()}
    assert got == pytest.approx({r[2]: plain(r[2]) for r in rows}, abs=1e-12)
    for made in (out, E.rolling_diffusion(df)):  # windows, not nested lambdas over all pairs of a window
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_deal_is_not_broadcast(spark):
    # sorted numbers take a few bytes of a file, so of millions of rows the planner made a broadcast, and the driver ran out of memory
    df = spark.range(2000).select(F.lit(1).alias("cell_id"), F.col("id").alias("mol_id"), F.lit(1).alias("frame"), (F.col("id") % 7).cast("double").alias("v"))
    out = stats.shuffled(df, "v", 1, ["cell_id", "mol_id", "frame"])
    assert sorted(r.v for r in out.collect()) == sorted(r.v for r in df.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2


@pytest.mark.parametrize("spread", [0.0, 0.3, 50.0])
def test_linking_looks_at_few_pairs(monkeypatch, spread):
    # all points are within reach of all tracks: near pairs are linked before far ones are listed
    rnd = np.random.default_rng(3)
    p, q = (np.round(20 + spread * rnd.normal(size=(n, 2)), 2) for n in (700, 800))
    d = np.sqrt(((p[:, None] - q) ** 2).sum(axis=2))
    want, taken = np.full(len(p), -1), set()
    for k, j in zip(*np.unravel_index(np.argsort(d.ravel(), kind="stable"), d.shape), strict=True):
        if want[k] < 0 and j not in taken:
            want[k] = j
            taken.add(j)
    looked, real = [], spatial._candidates
    monkeypatch.setattr(spatial, "_candidates", lambda *a: (lambda x: looked.append(len(x[1])) or x)(real(*a)))
    assert spatial.nearest_pairs(p, q, 1000.0).tolist() == want.tolist()
    assert sum(looked) < len(p) * len(q) / 4


def test_stream_state_is_bytes(spark, tmp_path, monkeypatch):
    # Spark hands a cell's state over with every batch of its rows: as arrays of numbers that took longer than linking
    kinds, real = [], type(spark.range(1).groupBy("id")).applyInPandasWithState
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandasWithState", lambda self, f, out, kept, *a: kinds.append(kept) or real(self, f, out, kept, *a))
    schema = "cell_id int, frame int, x_px double, y_px double"
    spark.createDataFrame([(1, 1, 0.0, 0.0)], schema).write.parquet(f"{tmp_path}/in")
    online.link_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert kinds and "array" not in kinds[0]
