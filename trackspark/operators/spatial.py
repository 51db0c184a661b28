"""Outlines of cells, points in them, cell coordinates, and linking of points into tracks (G).

Cells are a table of one row an outline (cell_id, mesh: array of (i, xl, yl, xr, yr) from pole to pole). Geometry is prepared once a
cell as arrays; points meet it by an equality or box join, and every test is an expression over the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.components import components
from ..functions.ranks import numbered
from ..functions.storage import written
from ..params import DEFAULT, Params


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def arms(mesh: Column) -> tuple[Column, Column]:
    return F.transform(mesh, lambda m: point(m["xl"], m["yl"])), F.transform(mesh, lambda m: point(m["xr"], m["yr"]))


def expand(poly: Column, by: float) -> Column:
    """Each vertex moved along the normal of the line through its neighbours."""
    n = F.size(poly)

    def move(p: Column, i: Column) -> Column:
        before, behind = F.get(poly, F.pmod(i - 1, n)), F.get(poly, F.pmod(i + 1, n))
        dx, dy = before["x"] - behind["x"], before["y"] - behind["y"]
        size = F.hypot(dx, dy)
        return point(p["x"] - F.coalesce(F.try_divide(by * dy, size), F.lit(0.0)), p["y"] + F.coalesce(F.try_divide(by * dx, size), F.lit(0.0)))

    return F.transform(poly, move)


def simplify(poly: Column, degrees: float) -> Column:
    """Without inner vertices at which the outline turns by no more than so many degrees."""
    n = F.size(poly)

    def turns(p: Column, i: Column) -> Column:
        a, b = F.get(poly, F.greatest(i - 1, F.lit(0))), F.get(poly, F.least(i + 1, n - 1))
        ux, uy, vx, vy = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
        return (i == 0) | (i == n - 1) | (F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy)) > degrees)

    return F.filter(poly, turns)


def with_roi(cells: DataFrame, by: float = -1.2, degrees: float = 1.0) -> DataFrame:
    """cells with roi: left arm and the inner part of the right arm backwards, expanded and simplified."""
    left, right = arms(F.col("mesh"))
    outline = F.concat(left, F.reverse(F.slice(right, 2, F.size("mesh") - 2)))
    return cells.withColumn("roi", outline).withColumn("roi", expand(F.col("roi"), by)).withColumn("roi", simplify(F.col("roi"), degrees))


def flip(df: DataFrame, height: float) -> DataFrame:
    return df.withColumn("y_px", height - F.col("y_px"))


def with_box(cells: DataFrame, poly: str = "roi") -> DataFrame:
    x, y = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return cells.withColumns({"x_min": F.array_min(x), "x_max": F.array_max(x), "y_min": F.array_min(y), "y_max": F.array_max(y)})


def edges(poly: Column, closed: bool = True) -> Column:
    n = F.size(poly)
    all_ = F.transform(poly, lambda p, i: F.struct(p.alias("a"), F.get(poly, F.pmod(i + 1, n)).alias("b")))
    return all_ if closed else F.slice(all_, 1, F.greatest(n - 1, F.lit(0)))


def inside(p: Column, edge: Column) -> Column:
    """Crossing number of a ray to the right."""

    def crosses(e: Column) -> Column:
        at = F.try_divide((e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
        return ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & F.coalesce(p["x"] < at, F.lit(False))

    return F.size(F.filter(edge, crosses)) % 2 == 1


def projected(p: Column, e: Column) -> Column:
    """(x, y, d): the nearest point of a segment and its distance."""
    ux, uy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.coalesce(F.try_divide((p["x"] - e["a"]["x"]) * ux + (p["y"] - e["a"]["y"]) * uy, ux * ux + uy * uy), F.lit(0.0))
    x = F.when(t >= 1, e["b"]["x"]).when(t <= 0, e["a"]["x"]).otherwise(e["a"]["x"] + t * ux)
    y = F.when(t >= 1, e["b"]["y"]).when(t <= 0, e["a"]["y"]).otherwise(e["a"]["y"] + t * uy)
    return F.struct(x.alias("x"), y.alias("y"), F.hypot(p["x"] - x, p["y"] - y).alias("d"))


def outline_distance(p: Column, edge: Column) -> Column:
    return F.array_min(F.transform(edge, lambda e: projected(p, e)["d"]))


def membrane_distance(df: DataFrame, cells: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """df with membrane_nm, the distance to the outline of its cell."""
    c = cells.select("cell_id", edges(F.col("roi")).alias("_e"))
    d = df.join(c, "cell_id", "left").withColumn("_at", point(F.col("x_px"), F.col("y_px")))
    return d.withColumn("membrane_nm", outline_distance(F.col("_at"), F.col("_e")) * p.px_scale).drop("_e", "_at")


def pole_distance(df: DataFrame, cells: DataFrame, p: Params = DEFAULT) -> DataFrame:
    first, last = F.element_at("mesh", 1), F.element_at("mesh", -1)
    c = cells.select("cell_id", point((first["xl"] + first["xr"]) / 2, (first["yl"] + first["yr"]) / 2).alias("_a"), point((last["xl"] + last["xr"]) / 2, (last["yl"] + last["yr"]) / 2).alias("_b"))
    d = df.join(c, "cell_id", "left").withColumn("_at", point(F.col("x_px"), F.col("y_px")))
    return d.withColumn("pole_nm", F.least(distance(F.col("_at"), F.col("_a")), distance(F.col("_at"), F.col("_b"))) * p.px_scale).drop("_a", "_b", "_at")


#: Side of a tile, pixels; bytes of outlines that are broadcast at most; rows of a tile that are one join key; and dense tiles whose list is broadcast at most.
TILE, MOST_BYTES, TILE_ROWS, MOST_DENSE = 64.0, 32 << 20, 100_000, 100_000


def in_boxes(points: DataFrame, cells: DataFrame, tile: float = TILE, most: int = MOST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """points with cell_id and depth (distance to the outline) for each cell whose outline holds them.

    A cell lies on the tiles that its box touches, a point on one; so a point meets only the cells near it, however many there are. Outlines of `most` bytes at most, by
    their counted vertices, are broadcast and points stay where they are; more of them meet the points by an equality join on tiles (dealt_tiles).
    """
    flat = F.flatten(F.transform(edges(F.col("roi")), lambda e: F.array(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    # as rows, so that the planner doesn't copy the outline's expressions into every use
    boxes = cells.select("cell_id", "x_min", "x_max", "y_min", "y_max", flat.alias("_f"))
    boxes = written(boxes)
    size = boxes.agg(F.sum(F.size("_f") * 8 + 64)).first()[0] or 0
    schema = StructType([*points.schema.fields, cells.schema["cell_id"], StructField("depth", DoubleType())])
    if size > most:
        return _in_joined_boxes(dealt_tiles(points, boxes, tile, tile_rows), points.columns, schema)
    shared = points.sparkSession.sparkContext.broadcast(boxes.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        low, high = (np.stack([held[c].cast(pa.float64()).to_numpy() for c in names], axis=1) for names in (("x_min", "y_min"), ("x_max", "y_max")))
        on: dict[tuple[int, int], list[int]] = {}
        outlines: dict[int, np.ndarray] = {}
        for k, (a, b) in enumerate(zip(np.floor(low / tile), np.floor(high / tile), strict=True)):
            if not np.isfinite([*a, *b]).all():
                continue
            for t in ((x, y) for x in range(int(a[0]), int(b[0]) + 1) for y in range(int(a[1]), int(b[1]) + 1)):
                on.setdefault(t, []).append(k)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, y = (part.column(n).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for n in ("x_px", "y_px"))
                there = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
                tiles, which = np.unique(np.floor(np.stack([x[there], y[there]], axis=1) / tile), axis=0, return_inverse=True)
                rows, of, depth = [], [], []
                for t, (tx, ty) in enumerate(tiles.tolist()):
                    own = there[which.ravel() == t]
                    for k in on.get((int(tx), int(ty)), ()):
                        near = own[(x[own] >= low[k, 0]) & (x[own] <= high[k, 0]) & (y[own] >= low[k, 1]) & (y[own] <= high[k, 1])]
                        if not len(near):
                            continue
                        if k not in outlines:
                            outlines[k] = held["_f"][k].values.to_numpy(zero_copy_only=False).reshape(-1, 4)
                        e = outlines[k]
                        column = (x[near, None], y[near, None], e[:, :2], e[:, 2:])
                        inside_ = _crossings(*column) % 2 == 1
                        rows.append(near[inside_])
                        of.append(np.full(len(rows[-1]), k))
                        depth.append(_nearest(*column)[3].min(axis=1)[inside_])
                if rows:
                    chosen = part.take(pa.array(np.concatenate(rows)))
                    cell = held["cell_id"].take(pa.array(np.concatenate(of))).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*chosen.columns, cell, pa.array(np.concatenate(depth))], names=schema.names)

    return points.mapInArrow(run, schema)


def dealt_tiles(points: DataFrame, boxes: DataFrame, tile: float, tile_rows: int) -> DataFrame:
    """points joined with the boxes (cell_id, x_min, x_max, y_min, y_max, _f) that hold them, by tile and part of a tile.

    Tiles with more rows than tile_rows are dealt into as many parts as keep within it, so no join key is larger; a box meets all parts of its tiles.
    """
    by = lambda c: F.floor(F.col(c) / tile)
    c = boxes.withColumn("_tx", F.explode(F.sequence(by("x_min"), by("x_max")))).withColumn("_ty", F.explode(F.sequence(by("y_min"), by("y_max"))))
    p = points.withColumns({"_tx": by("x_px"), "_ty": by("y_px")})
    dense = written(p.groupBy("_tx", "_ty").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_parts")).where("_parts > 1"))
    few = dense.count() <= MOST_DENSE
    known = F.broadcast(dense) if few else dense
    p = p.join(known, ["_tx", "_ty"], "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    c = c.join(known, ["_tx", "_ty"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("_parts", F.lit(1)) - 1).cast("long")))).drop("_parts")
    j = p.join(c, ["_tx", "_ty", "_part"])
    return j.where(F.col("x_px").between(F.col("x_min"), F.col("x_max")) & F.col("y_px").between(F.col("y_min"), F.col("y_max")))


def _in_joined_boxes(joined: DataFrame, names: Sequence[str], schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, y = (part.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("x_px", "y_px"))
                cell = part.column("cell_id").dictionary_encode().indices.to_numpy()
                depth, held = np.zeros(len(x)), np.zeros(len(x), bool)
                for k in range(int(cell.max()) + 1 if len(cell) else 0):
                    rows = np.flatnonzero(cell == k)
                    e = np.array(part.column("_f")[int(rows[0])].as_py()).reshape(-1, 4)
                    column = (x[rows, None], y[rows, None], e[:, :2], e[:, 2:])
                    held[rows] = _crossings(*column) % 2 == 1
                    depth[rows] = _nearest(*column)[3].min(axis=1)
                chosen = pa.table({**{n: part.column(n) for n in schema.names[:-1]}, "depth": pa.array(depth)}).filter(pa.array(held))
                yield from chosen.to_batches()

    return joined.select(*names, "cell_id", "_f").mapInArrow(run, schema)


def assign_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (id, x_px, y_px) with the cell whose outline holds them; of several the one they are deepest in. cells need roi and a box."""
    held = in_boxes(points.select("id", "x_px", "y_px"), cells)
    best = F.min(F.struct((-F.col("depth")).alias("d"), "cell_id", "x_px", "y_px")).alias("b")
    return held.groupBy("id").agg(best).select("id", "b.x_px", "b.y_px", "b.cell_id", (-F.col("b.d")).alias("depth"))


def assign_tracks(tracks: DataFrame, cells: DataFrame, least: int = 5) -> DataFrame:
    """track_id, cell_id, share: the first cell that holds more than half of a track's points; tracks need `least` rows and distinct frames."""
    n = tracks.groupBy("track_id").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("f")).where((F.col("n") >= least) & (F.col("n") == F.col("f"))).drop("f")
    held = in_boxes(tracks.select("track_id", "x_px", "y_px"), cells).groupBy("track_id", "cell_id").agg(F.count("*").alias("k"))
    share = held.join(n, "track_id").withColumn("share", F.col("k") / F.col("n")).where("share > 0.5")
    return share.groupBy("track_id").agg(F.min(F.struct("cell_id", "share")).alias("b")).select("track_id", "b.*")


def midlines(cells: DataFrame) -> DataFrame:
    """cells with midline (mean of the arms), contour (its length), and the polygons of both halves."""
    left, right = arms(F.col("mesh"))
    c = cells.withColumns({"left": left, "right": right, "midline": F.transform("mesh", lambda m: point((m["xl"] + m["xr"]) / 2, (m["yl"] + m["yr"]) / 2))})
    c = c.withColumn("contour", F.aggregate(edges(F.col("midline"), closed=False), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"])))
    return c.withColumns({"left_half": F.concat("left", F.reverse("midline")), "right_half": F.concat("right", F.reverse("midline"))})


#: Rows that meet all segments of their cell's midline at once.
TOGETHER = 2000
COORDINATES = {"longitude": DoubleType(), "longitude_px": DoubleType(), "latitude": DoubleType(), "latitude_px": DoubleType(), "side": IntegerType(), "beyond": BooleanType()}


def cell_coordinates(df: DataFrame, cells: DataFrame) -> DataFrame:
    """df with longitude, latitude (shares, centred) and longitude_px, latitude_px, along and across the midline of its cell, side and beyond.

    The nearest midline segment gives the longitude; the side (1 left, -1 right) is that of the half that holds the point, or else of the nearer arm; the
    latitude is the offset over the half width along the same ray. Beyond a pole both are extrapolated from the last segment. Rows without
    coordinates have nulls. Geometry comes to the rows by an equality join, and Arrow batches of rows are measured against it cell by cell.
    """
    flat = F.flatten(F.transform("mesh", lambda m: F.array(m["xl"].cast("double"), m["yl"].cast("double"), m["xr"].cast("double"), m["yr"].cast("double"))))
    joined = df.join(cells.select("cell_id", flat.alias("_mesh")), "cell_id")
    kept = [c for c in joined.columns if c not in ("_mesh", *COORDINATES)]
    schema = StructType([*[joined.schema[c] for c in kept], *[StructField(name, kind) for name, kind in COORDINATES.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, y = (part.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("x_px", "y_px"))
                cell = part.column("cell_id").dictionary_encode().indices.to_numpy()
                out = np.zeros((len(COORDINATES), len(x)))
                for k in range(int(cell.max()) + 1 if len(cell) else 0):
                    rows = np.flatnonzero(cell == k)
                    mesh = np.array(part.column("_mesh")[int(rows[0])].as_py()).reshape(-1, 4)
                    out[:, rows] = _coordinates(x[rows], y[rows], mesh)
                lost = np.isnan(x) | np.isnan(y)
                found = [pa.array(v, pa.float64(), mask=lost | np.isnan(v)) for v in out[:4]]
                found += [pa.array(out[4].astype(np.int32), mask=lost), pa.array(out[5] > 0, mask=lost)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *found], names=schema.names)

    return joined.mapInArrow(run, schema)


def _nearest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Share along each segment a-b of the nearest point to each (x, y), the point, and its distance: rows by segments."""
    u = b - a
    with np.errstate(invalid="ignore", divide="ignore"):
        t = ((x - a[:, 0]) * u[:, 0] + (y - a[:, 1]) * u[:, 1]) / (u * u).sum(axis=1)
    t = np.clip(np.where(np.isnan(t) & ~np.isnan(x), 0.0, t), 0.0, 1.0)
    px, py = (np.where(t >= 1, b[:, i], np.where(t <= 0, a[:, i], a[:, i] + t * u[:, i])) for i in (0, 1))
    return t, px, py, np.hypot(x - px, y - py)


def _crossings(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many segments a ray to the right of each point crosses."""
    with np.errstate(invalid="ignore", divide="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        return (((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum(axis=1)


def _length(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As SQL takes it: np.hypot rounds otherwise, and what is equally near is then decided otherwise."""
    return np.sqrt(x * x + y * y)


def _arm_distance(x: np.ndarray, y: np.ndarray, arm: np.ndarray) -> np.ndarray:
    """Distance of each (x, y) to the nearest segment of an arm, rounded step by step as in the SQL: at a pole, which both arms share, only rounding says which is nearer."""
    a, u = arm[:-1], arm[1:] - arm[:-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        t = ((x - a[:, 0]) * u[:, 0] + (y - a[:, 1]) * u[:, 1]) / (u[:, 0] * u[:, 0] + u[:, 1] * u[:, 1])
    t = np.clip(np.where(np.isnan(t) & ~np.isnan(x), 0.0, t), 0.0, 1.0)
    return _length(x - a[:, 0] - t * u[:, 0], y - a[:, 1] - t * u[:, 1]).min(axis=1)


def _coordinates(x: np.ndarray, y: np.ndarray, mesh: np.ndarray) -> np.ndarray:
    left, right = mesh[:, :2], mesh[:, 2:]
    mid = (left + right) / 2
    a, b = mid[:-1], mid[1:]
    u = b - a
    lengths = _length(u[:, 0], u[:, 1])
    before, contour = np.concatenate([[0.0], np.cumsum(lengths)])[:-1], lengths.sum()
    column = (x[:, None], y[:, None])
    with np.errstate(invalid="ignore", divide="ignore"):
        t = ((column[0] - a[:, 0]) * u[:, 0] + (column[1] - a[:, 1]) * u[:, 1]) / (lengths * lengths)
    t = np.clip(np.where(np.isnan(t) & ~np.isnan(column[0]), 0.0, t), 0.0, 1.0)
    px, py = (np.where(t >= 1, b[:, k], np.where(t <= 0, a[:, k], a[:, k] + t * u[:, k])) for k in (0, 1))
    d = _length(column[0] - px, column[1] - py)
    i, rows = d.argmin(axis=1), np.arange(len(x))
    t, px, py, d, last = t[rows, i], px[rows, i], py[rows, i], d[rows, i], len(a) - 1
    lon = before[i] + _length(px - a[i, 0], py - a[i, 1])

    on_mid = _crossings(*column, a, b)
    in_left, in_right = ((_crossings(*column, arm[:-1], arm[1:]) + on_mid) % 2 == 1 for arm in (left, right))
    nearer = _arm_distance(*column, left) < _arm_distance(*column, right)
    is_left = in_left | ~in_right & nearer
    p, q = (np.where(is_left[:, None], left[i + k], right[i + k]) for k in (0, 1))

    # the ray from the midline point through the point meets the arm at share s of their distance: s solves t + s (c - t) on the arm's line
    vx, vy, ux, uy = x - px, y - py, q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        s = ((p[:, 0] - px) * uy - (p[:, 1] - py) * ux) / (vx * uy - vy * ux)
        lat = np.where((vx == 0) & (vy == 0), 0.0, 1 / np.abs(s))
    beyond = ~np.isfinite(lat) | (i == 0) & (t <= 0)
    end = (i == last) & (t >= 1)
    p0, p1 = np.where(end[:, None], b[i], a[i]), np.where(end[:, None], a[i], b[i])
    w, c = p1 - p0, np.stack([x, y], axis=1) - p0
    size = np.hypot(*w.T)
    with np.errstate(invalid="ignore", divide="ignore"):
        far = np.abs((c * w).sum(axis=1) / size)
        off = np.where(size == 0, np.hypot(*c.T), np.abs(w[:, 0] * c[:, 1] - w[:, 1] * c[:, 0]) / size)
        share = off / ((np.hypot(*(p - p0).T) + np.hypot(*(q - p1).T)) / 2)
    lon = np.where(beyond & (i == 0), -far, np.where(beyond & (i == last), far + contour, np.where(beyond, far, lon)))
    sign = np.where(is_left, 1.0, -1.0)
    return np.stack([lon / contour - 0.5, lon - contour / 2, sign * np.where(beyond, share, lat) / 2, sign * np.where(beyond, off, d), sign, beyond])


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return df.withColumns({"x_rot": F.col("x_px") * c - F.col("y_px") * s, "y_rot": F.col("x_px") * s + F.col("y_px") * c})


def model_cell(df: DataFrame, length: float, width: float) -> DataFrame:
    """df with mx, my and valid: longitude and latitude scaled to a pill of this size, y shrunk in the caps."""
    x, y = F.col("longitude") * length, F.col("latitude") * width
    cap = F.abs(x) - (length / 2 - width / 2)
    inner = (width / 2) ** 2 - cap * cap
    radius = F.when(inner >= 0, F.sqrt(inner))
    shrunk = F.when(cap > 0, y * radius / (width / 2)).otherwise(y)
    valid = F.when(cap > 0, radius.isNotNull() & (F.abs(shrunk) <= radius)).otherwise(F.abs(y) <= width / 2)
    return df.withColumns({"mx": x, "my": shrunk, "valid": F.coalesce(valid, F.lit(False))})


#: Candidates that are looked at together, for each point and track.
CANDIDATES = 8


def _candidates(p: np.ndarray, q: np.ndarray, reach: float, narrow: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """A reach r up to `reach`, and all (distance, point of p, point of q) within r. With narrow, r is halved until neighbouring tiles as wide as r hold few pairs."""
    low = np.minimum(p.min(axis=0), q.min(axis=0))
    wide = (np.maximum(p.max(axis=0), q.max(axis=0)) - low).max()
    while True:
        tile = max(reach * (1 + 1e-6), wide / 2.0**28)
        at, of = (np.floor((z - low) / tile).astype(np.int64) + 1 for z in (p, q))
        size = max(at[:, 1].max(), of[:, 1].max()) + 2
        name = of[:, 0] * size + of[:, 1]
        order = np.argsort(name, kind="stable")
        name = name[order]
        # the tiles above and below lie together, so each of three columns is one range
        centre = np.stack([(at[:, 0] + c) * size + at[:, 1] for c in (-1, 0, 1)], axis=1).ravel()
        first, count_ = np.searchsorted(name, centre - 1), np.searchsorted(name, centre + 1, side="right")
        count_ -= first
        total = int(count_.sum())
        if not narrow or total <= CANDIDATES * (len(p) + len(q)) + 1000 or reach / 2 < wide / 2.0**28:
            break
        reach /= 2
    k = np.repeat(np.repeat(np.arange(len(p)), 3), count_)
    j = order[np.arange(total) + np.repeat(first - np.cumsum(count_) + count_, count_)]
    dx, dy = p[k, 0] - q[j, 0], p[k, 1] - q[j, 1]
    d = np.sqrt(dx * dx + dy * dy)
    near = d <= reach
    return reach, d[near], k[near], j[near]


def _nearest_first(d: np.ndarray, k: np.ndarray, j: np.ndarray, match: np.ndarray, taken: np.ndarray) -> None:
    """Links pairs (k, j) in order of (d, k, j), each of either once: writes j to match[k]. A pair that comes first for both of its ends is linked whatever the others do."""
    order = np.lexsort((j, k, d))
    k, j = k[order], j[order]
    lead_k, lead_j = np.zeros(len(match), np.int64), np.zeros(len(taken), np.int64)
    while len(k) > 200:
        at = np.arange(len(k))
        lead_k[k[::-1]] = at[::-1]
        lead_j[j[::-1]] = at[::-1]
        now = (lead_k[k] == at) & (lead_j[j] == at)
        match[k[now]] = j[now]
        taken[j[now]] = True
        left = (match[k] < 0) & ~taken[j]
        k, j = k[left], j[left]
    for a, b in zip(k.tolist(), j.tolist(), strict=True):
        if match[a] < 0 and not taken[b]:
            match[a], taken[b] = b, True


def nearest_pairs(p: np.ndarray, q: np.ndarray, dist: float) -> np.ndarray:
    """For each point of p its point of q, or -1: of all pairs within dist the nearest is linked first; ties go to the first point of p, then of q.

    Near pairs are linked before far ones are listed: from a reach within which there are few of them, it is doubled up to dist, over what is left.
    Equal places are linked at once, in order.
    """
    match, taken = np.full(len(p), -1), np.zeros(len(q), bool)
    ok, oj = (np.flatnonzero(np.isfinite(z).all(axis=1)) for z in (p, q))
    if not len(ok) or not len(oj) or not dist >= 0:
        return match
    place = np.unique(np.concatenate([p[ok], q[oj]]) + 0.0, axis=0, return_inverse=True)[1].ravel()

    def numbered_(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        nth = np.empty(len(of), np.int64)
        nth[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        return of, nth

    a, b = (z * (len(place) + 1) + n for z, n in (numbered_(place[: len(ok)]), numbered_(place[len(ok) :])))
    _, i, o = np.intersect1d(a, b, return_indices=True)
    match[ok[i]], taken[oj[o]] = oj[o], True
    reach, narrow = dist, True
    while True:
        ks, js = ok[match[ok] < 0], oj[~taken[oj]]
        if not len(ks) or not len(js) or dist == 0:
            return match
        reach, d, k, j = _candidates(p[ks], q[js], reach, narrow)
        _nearest_first(d, ks[k], js[j], match, taken)
        if reach >= dist:
            return match
        reach, narrow = min(dist, 2 * reach), False


class Linker:
    """Greedy linking of points, frame after frame: the state between frames is the open tracks (id, x, y, last frame), in order of id.

    The nearest pair of a point and an open track links first; ties go to the point that comes first, then to the older track (nearest_pairs).
    """

    def __init__(self, mem: int, dist: float, open_: Sequence[tuple[int, float, float, int]] = ()):
        self.mem, self.dist = mem, dist
        self._id, self._last = (np.array([t[c] for t in open_], np.int64) for c in (0, 3))
        self._at = np.array([t[1:3] for t in open_], float).reshape(-1, 2)

    @property
    def open(self) -> list[tuple[int, float, float, int]]:
        return list(zip(self._id.tolist(), self._at[:, 0].tolist(), self._at[:, 1].tolist(), self._last.tolist(), strict=True))

    def frame(self, frame: int, points: Sequence[tuple[float, float]] | np.ndarray, fresh: Callable[[int], int]) -> list[int]:
        """Track ids of the points of a frame, which must come after those seen before; fresh(k) is the id of a track that starts with point k."""
        kept = frame - self._last <= self.mem + 1
        self._id, self._at, self._last = self._id[kept], self._at[kept], self._last[kept]
        points = np.asarray(points, float).reshape(-1, 2)
        match = nearest_pairs(points, self._at, self.dist)
        old = match >= 0
        self._at[match[old]], self._last[match[old]] = points[old], frame
        ids = np.zeros(len(points), np.int64)
        ids[old] = self._id[match[old]]
        new = np.flatnonzero(~old)
        ids[new] = [fresh(int(k)) for k in new]
        self._id, self._at = np.concatenate([self._id, ids[new]]), np.concatenate([self._at, points[new]])
        self._last = np.concatenate([self._last, np.full(len(new), frame)])
        return ids.tolist()


#: Boxes to a side of what one partition looks at first for connected ones.
NEAR = 16


def with_piece(locs: DataFrame, mem: int, dist: float, keys: Sequence[str]) -> DataFrame:
    """locs with _piece: rows of different pieces can't be in one track, whatever lies between them.

    Rows lie in boxes as wide as the reach in x and y and mem + 1 frames long; two that can link are in the same box or in neighbouring ones. Pieces are the
    connected groups of occupied boxes. Rows without a place are pieces of their own frame.
    """
    width = dist if dist > 0 else 1e-9
    at = {"_f": F.floor(F.col("frame") / (mem + 1)), "_x": F.floor(F.col("x_px") / width), "_y": F.floor(F.col("y_px") / width)}
    name = lambda f, x, y: F.xxhash64(*keys, f, x, y)  # noqa: E731  two boxes of one name only join two pieces
    box = locs.withColumns(at).withColumn("_box", name(F.col("_f"), F.col("_x"), F.col("_y")))
    boxes = written(box.select(*keys, *at, "_box").where("_f IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL").distinct())
    # half of the 26 neighbours: each pair of boxes meets once
    steps = [(f, x, y) for f in (0, 1) for x in (-1, 0, 1) for y in (-1, 0, 1) if (f, x, y) > (0, 0, 0)]
    beside = F.array(*[name(F.col("_f") + f, F.col("_x") + x, F.col("_y") + y) for f, x, y in steps])
    asked = boxes.select(*keys, "_x", "_y", F.col("_box").alias("a"), F.explode(beside).alias("b"))
    edges = asked.join(boxes.select(F.col("_box").alias("b")), "b").repartition(*keys, F.floor(F.col("_x") / NEAR), F.floor(F.col("_y") / NEAR)).select("a", "b")
    labels = components(edges).select(F.col("node").alias("_box"), "label")
    return box.join(labels, "_box", "left").withColumn("_piece", F.coalesce("label", "_box")).drop("_box", "label", *at)


def link_tracks(locs: DataFrame, mem: int = DEFAULT.mem_param, dist: float = DEFAULT.link_dist, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """locs (keys, frame, x_px, y_px, ...) with mol_id, from 1 in each cell in the order in which tracks start. Points of a frame are taken in order of (x, y).

    Rows that can't influence each other are linked apart (with_piece), so one cell takes many tasks; inside a piece time is sequential. Tracks are
    numbered over ranges of their first points.
    """
    schema = StructType([*[f for f in locs.schema.fields if f.name != "mol_id"], StructField("_piece", LongType()), StructField("_track", LongType())])
    d = with_piece(locs.drop("mol_id"), mem, dist, keys)

    def link(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["frame", "x_px", "y_px"], kind="stable")
        linker, ids, started = Linker(mem, dist), [], count(1)
        for frame, rows in t[["frame", "x_px", "y_px"]].groupby("frame", sort=True):
            ids += linker.frame(int(frame), rows[["x_px", "y_px"]].to_numpy(), lambda _: next(started))
        return t.assign(_track=ids)[schema.names]

    linked = written(d.groupBy(*keys, "_piece").applyInPandas(link, schema))
    track = [*keys, "_piece", "_track"]
    first = linked.groupBy(*track).agg(F.min(F.struct("frame", "x_px", "y_px")).alias("_at")).select(*track, "_at.*")
    named = numbered(first, list(keys), ["frame", "x_px", "y_px", "_piece", "_track"], "mol_id", "long").select(*track, "mol_id")
    return linked.join(named.hint("merge"), track).select(*[f.name for f in locs.schema.fields if f.name != "mol_id"], "mol_id")
