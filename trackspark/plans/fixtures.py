"""Track tables derived from the driver's events, and the same derivations in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCS = """b0 AS (
  SELECT user_id, event_id, value, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn0 FROM events),
b1 AS (
  SELECT *, CASE WHEN user_id % 10 = 3 AND rn0 <= 1 + CAST(FLOOR(user_id / 10) AS BIGINT) % 3 THEN user_id + 1000000 ELSE user_id END AS mol_id FROM b0),
b AS (
  SELECT mol_id, CAST(user_id % 7 AS INT) AS cell_id, event_id, value,
         CAST(ROW_NUMBER() OVER (PARTITION BY mol_id ORDER BY ts, event_id) AS INT) AS rn
  FROM b1),
c AS (SELECT *, CAST(1 + (CAST(FLOOR((rn - 1) / 12) AS BIGINT) + mol_id) % 3 AS INT) AS class_label FROM b),
d AS (
  SELECT *, CASE WHEN event_id % 31 = 0 THEN 0 ELSE ((event_id * 7919) % 1001 - 500) * (class_label * class_label) END AS dx_i,
    CASE WHEN event_id % 31 = 0 THEN 0 ELSE ((event_id * 104729) % 1001 - 500) * (class_label * class_label) END AS dy_i,
    CASE WHEN event_id % 97 = 0 THEN 6 + event_id % 15 WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS gap FROM c),
locs AS (
  SELECT cell_id, mol_id, CAST((mol_id * 37) % 400 + rn + SUM(gap) OVER w AS INT) AS frame,
    CAST(20.0 AS DOUBLE) + CAST(SUM(dx_i) OVER w AS BIGINT) / CAST(1000.0 AS DOUBLE) AS x_px,
    CAST(20.0 AS DOUBLE) + CAST(SUM(dy_i) OVER w AS BIGINT) / CAST(4000.0 AS DOUBLE) AS y_px,
    value AS photons,
    CAST(1.0 AS DOUBLE) + (event_id % 13) / CAST(20.0 AS DOUBLE) AS sigma_x_px,
    CAST(1.0 AS DOUBLE) + (event_id % 17) / CAST(20.0 AS DOUBLE) AS sigma_y_px,
    class_label,
    CAST(CASE WHEN event_id % 11 = 0 THEN 1 + class_label % 3 ELSE class_label END AS INT) AS pred_label
  FROM d WINDOW w AS (PARTITION BY mol_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

PAIRS = f"""{LOCS},
pairs AS (
  SELECT CAST(FLOOR(mol_id / 2) AS INT) AS cell_id, mol_id,
    CAST(frame + (mol_id % 2) * 20 * (CAST(FLOOR(mol_id / 2) AS BIGINT) % 4) AS INT) AS frame,
    x_px, y_px, photons, sigma_x_px, sigma_y_px, class_label, pred_label
  FROM locs)"""

#: A bent, tilted cell of unequal arms: the middle line, and how far the arms are from it.
_MID = {"x": "(2.0 + 4.1 * {i})", "y": "(17.5 + 0.5 * {i} + 0.06 * ({i} - 5) * ({i} - 5))"}
_ARMS = {"l": (-0.15, (0.0, 6.0, 9.0)), "r": (0.1, (0.0, -5.0, -8.0))}


def _arm(side: str, axis: str, i: str) -> str:
    """SQL of a coordinate of an arm at mesh row i of 0..10; poles lie on the middle line."""
    shift, far = _ARMS[side]
    mid = _MID[axis].format(i=i)
    if axis == "x":
        return f"CASE WHEN {i} IN (0, 10) THEN {mid} ELSE {mid} + ({shift}) * ({i} - 5) END"
    return f"{mid} + CASE WHEN {i} IN (0, 10) THEN {far[0]} WHEN {i} IN (1, 9) THEN {far[1]} ELSE {far[2]} END"


MESH = f"""mesh AS (
  SELECT cell_id, i, {", ".join(f"CAST({_arm(side, axis, 'CAST(i AS DOUBLE)')} AS DOUBLE) AS {axis}{side}" for side in "lr" for axis in "xy")}
  FROM (SELECT c.cell_id, CAST(n.n_nationkey AS INT) AS i FROM (SELECT DISTINCT CAST(user_id % 7 AS INT) AS cell_id FROM events) c CROSS JOIN nation n WHERE n.n_nationkey <= 10))"""

VIDEOS = "videos AS (SELECT * FROM (VALUES (0, 150), (1, 150), (2, 250)) AS t(file_idx, n_frames))"


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (cell_id, mol_id, frame): tracks of one row and up, with gaps of up to 21 frames, rows that stand still and rows beyond the poles."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, e = F.col("user_id"), F.col("event_id")
    order = Window.partitionBy("mol_id").orderBy("ts", "event_id")
    run = Window.partitionBy("mol_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    apart = (user % 10 == 3) & (F.col("rn0") <= 1 + F.floor(user / 10) % 3)  # the first one to three rows of some users are tracks of their own
    b0 = events.select("user_id", (user % 7).cast("int").alias("cell_id"), "event_id", "ts", "value").withColumn("rn0", first)
    b = b0.withColumn("mol_id", F.when(apart, user + 1_000_000).otherwise(user)).drop("user_id", "rn0").withColumn("rn", F.row_number().over(order))
    label = (1 + (F.floor((F.col("rn") - 1) / 12) + F.col("mol_id")) % 3).cast("int")
    d = b.withColumn("class_label", label).withColumns({
        "dx": F.when(e % 31 == 0, 0).otherwise(((e * 7919) % 1001 - 500) * F.col("class_label") * F.col("class_label")),
        "dy": F.when(e % 31 == 0, 0).otherwise(((e * 104729) % 1001 - 500) * F.col("class_label") * F.col("class_label")),
        "gap": F.when(e % 97 == 0, 6 + e % 15).when(e % 9 == 0, 1).otherwise(0),
    })
    return d.select(
        "cell_id",
        "mol_id",
        ((F.col("mol_id") * 37) % 400 + F.col("rn") + F.sum("gap").over(run)).cast("int").alias("frame"),
        (20.0 + F.sum("dx").over(run) / F.lit(1000.0)).alias("x_px"),
        (20.0 + F.sum("dy").over(run) / F.lit(4000.0)).alias("y_px"),
        F.col("value").alias("photons"),
        (1.0 + (e % 13) / F.lit(20.0)).alias("sigma_x_px"),
        (1.0 + (e % 17) / F.lit(20.0)).alias("sigma_y_px"),
        "class_label",
        F.when(e % 11 == 0, 1 + F.col("class_label") % 3).otherwise(F.col("class_label")).cast("int").alias("pred_label"),
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two molecules a cell, some of which overlap in time."""
    half = F.floor(F.col("mol_id") / 2)
    return locs(spark, sf_dir).withColumns({"cell_id": half.cast("int"), "frame": (F.col("frame") + (F.col("mol_id") % 2) * 20 * (half % 4)).cast("int")})


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines, long form: 11 rows a cell."""
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 7).cast("int").alias("cell_id")).distinct()
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey <= 10").select(F.col("n_nationkey").cast("int").alias("i"))
    arms = [F.expr(f"CAST({_arm(side, axis, 'CAST(i AS DOUBLE)')} AS DOUBLE)").alias(axis + side) for side in "lr" for axis in "xy"]
    return cells.join(F.broadcast(rows), F.lit(True)).select("cell_id", "i", *arms)  # eleven rows


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cell: mesh as an array in order, and the length along x."""
    m = mesh(spark, sf_dir).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "xl", "yl", "xr", "yr"))).alias("mesh"))
    return m.withColumn("length_px", F.element_at("mesh", -1)["xl"] - F.element_at("mesh", 1)["xl"])


def videos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 150), (1, 150), (2, 250)], "file_idx int, n_frames int")
