"""Readers of tracks, localisations, outlines, truth and external segmentations (S), into tables of the library's names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, track
from ..params import DEFAULT, Params

#: Columns of a tracker's table that are not read, and the names of those that are.
TRACKER_DROPPED = ("LABEL", "RADIUS", "POSITION_T", "VISIBILITY", "ID")
TRACKER_NAMES = {"POSITION_X": "x_px", "POSITION_Y": "y_px", "POSITION_Z": "z", "FRAME": "frame", "TRACK_ID": "mol_id", "MAX_INTENSITY_CH1": "max_intensity", "TOTAL_INTENSITY_CH1": "total_intensity"}
#: Localisation columns and their names here.
LOCALISATION_NAMES = {"x": "x_px", "y": "y_px", "bg": "background", "sx": "sigma_x_px", "sy": "sigma_y_px", "lpx": "precision_x_px", "lpy": "precision_y_px", "net_gradient": "net_gradient", "ellipticity": "ellipticity", "photons": "photons"}


def frame_offsets(videos: DataFrame) -> DataFrame:
    """videos (file_idx, n_frames) with frame_offset, the frames of all files before; one row a file."""
    w = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    return videos.withColumn("frame_offset", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))


def find_frame(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """frames (1-based) with file_idx and frame_in_file; videos are a row a file. Frames outside all files have no row.

    Frames meet files by equality of blocks of frames, as long as a file is on average: a file lies on the blocks that it touches, a frame on one.
    """
    size = videos.agg(F.ceil(F.avg(F.when(F.col("n_frames") > 0, F.col("n_frames"))))).first()[0] or 1
    block = lambda c: F.floor((c - 1) / F.lit(size))
    v = frame_offsets(videos).where("n_frames > 0").select("file_idx", F.col("frame_offset").alias("_o"), "n_frames")
    v = v.withColumn("_b", F.explode(F.sequence(block(F.col("_o") + 1), block(F.col("_o") + F.col("n_frames")))))
    found = frames.withColumn("_b", block(F.col("frame"))).join(v, "_b").where((F.col("frame") > F.col("_o")) & (F.col("frame") <= F.col("_o") + F.col("n_frames")))
    return found.select(*frames.columns, "file_idx", (F.col("frame") - F.col("_o")).alias("frame_in_file"))


def tracker_tables(spark: SparkSession, paths: Sequence[str], videos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tracks of several tracker CSVs, a file each video in order: frames shifted by the video's offset, ids kept apart, micrometres to pixels, frames from 1.

    Files must have the same columns. Header rows below the first, columns without numbers and a z of zeros are dropped.
    """
    tables = [spark.read.csv(x, header=True) for x in paths]
    if len({tuple(t.columns) for t in tables}) > 1:
        raise ValueError("the files have different columns")
    named = [t.withColumn("file_idx", F.lit(i)) for i, t in enumerate(tables)]
    return tracker_columns(reduce(DataFrame.unionByName, named), videos, p)


def tracker_columns(raw: DataFrame, videos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """tracker_tables() for rows that are read already, with file_idx."""
    columns = [c for c in raw.columns if c not in (*TRACKER_DROPPED, "file_idx")]
    numbers = raw.select("file_idx", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in columns]).where(F.col("POSITION_X").isNotNull() & F.col("FRAME").isNotNull())
    seen = numbers.agg(*[F.count(c).alias(c) for c in columns], *([F.max(F.abs("POSITION_Z")).alias("_z")] if "POSITION_Z" in columns else [])).first()
    kept = [c for c in columns if seen[c] and not (c == "POSITION_Z" and seen["_z"] == 0)]
    tops = numbers.groupBy("file_idx").agg(F.max("TRACK_ID").alias("_top"))
    ids = tops.withColumn("_ids", F.coalesce(F.sum(F.col("_top") + 1).over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_top")
    d = numbers.join(F.broadcast(ids), "file_idx").join(F.broadcast(frame_offsets(videos).select("file_idx", "frame_offset")), "file_idx")
    named: dict[str, Column] = {c: F.col(c) for c in kept}
    named |= {"POSITION_X": F.col("POSITION_X") * 1000 / p.px_scale, "POSITION_Y": F.col("POSITION_Y") * 1000 / p.px_scale, "FRAME": (F.col("FRAME") + F.col("frame_offset") + 1).cast("int"), "TRACK_ID": (F.col("TRACK_ID") + F.col("_ids")).cast("long")}
    return d.select("file_idx", *[c.alias(TRACKER_NAMES.get(k, k.lower())) for k, c in named.items()])


def localisations(df: DataFrame) -> DataFrame:
    """A localisation table (x, y, frame from 0, ...) with x_px, y_px and frame (from 1) first, known columns renamed, others kept."""
    if missing := [c for c in ("x", "y", "frame") if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    rest = [c for c in df.columns if c not in ("x", "y", "frame")]
    return df.select(F.col("x").alias("x_px"), F.col("y").alias("y_px"), (F.col("frame") + 1).cast("int").alias("frame"), *[F.col(c).alias(LOCALISATION_NAMES.get(c, c)) for c in rest])


def attach_localisations(tracks: DataFrame, locs: DataFrame) -> DataFrame:
    """tracks with the other columns of the localisation of the same cell, frame and exact position; of several the first by all columns."""
    by = ["cell_id", "frame", "x_px", "y_px"]
    extra = [c for c in locs.columns if c not in by and c not in tracks.columns]
    one = locs.groupBy(*by).agg(F.min(F.struct(*extra)).alias("_l"))
    return tracks.join(one, by, "left").select(*tracks.columns, *[F.col("_l")[c].alias(c) for c in extra])


def outlines(rows: DataFrame) -> DataFrame:
    """Cells with mesh from long rows (cell_id, i, xl, yl, xr, yr), or from a table that has the array; cells without mesh are dropped."""
    if "mesh" not in rows.columns:
        rows = rows.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "xl", "yl", "xr", "yr"))).alias("mesh"))
    return rows.where(F.coalesce(F.size("mesh"), F.lit(0)) > 0)


def outline_files(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """outlines() from files: `csv` with a row for each cell and mesh row (cell_id, i, xl, yl, xr, yr), or `json` with a cell and its array of them a line."""
    if kind == "csv":
        return outlines(spark.read.csv(path, header=True, schema="cell_id int, i int, xl double, yl double, xr double, yr double"))
    return outlines(spark.read.json(path, schema="cell_id int, mesh array<struct<i:int,xl:double,yl:double,xr:double,yr:double>>"))


def ground_truth(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Truth rows (file_idx, class, frame, mol, cell) with frames shifted by their video's offset."""
    o = F.broadcast(frame_offsets(videos).select("file_idx", "frame_offset"))
    return rows.join(o, "file_idx").select(F.col("cell").cast("int").alias("cell_id"), F.col("mol").cast("long").alias("mol_id"), (F.col("frame") + F.col("frame_offset")).cast("int").alias("frame"), F.col("class").cast("int").alias("class_label"))


def ground_truth_files(spark: SparkSession, paths: Sequence[str], videos: DataFrame) -> DataFrame:
    """ground_truth() of tab-separated files in the order of their videos."""
    parts = [spark.read.csv(x, sep="\t", schema="class double, frame double, mol double, cell double").withColumn("file_idx", F.lit(i)) for i, x in enumerate(paths)]
    return ground_truth(reduce(DataFrame.unionByName, parts), videos)


def segmentation_lines(lines: DataFrame) -> DataFrame:
    """traj_idx, seg, k, state, cp, length from text lines `id,(k,unused,state,cp)...`, whose last cp is the track's length."""
    f = lines.select(F.split("value", ",").alias("f")).where(F.size("f") >= 5)
    n = F.floor((F.size("f") - 1) / 4).cast("int")

    def field(i: Column, k: int) -> Column:
        return F.get("f", 4 * (i - 1) + k)

    s = f.select(F.trim(F.get("f", F.lit(0))).cast("double").cast("long").alias("traj_idx"), F.trim(F.element_at("f", 4 * n + 1)).cast("double").cast("long").alias("length"), F.explode(F.sequence(F.lit(1), n)).alias("seg"), "f")
    i = F.col("seg")
    return s.select("traj_idx", "seg", F.trim(field(i, 1)).cast("double").alias("k"), F.trim(field(i, 3)).cast("double").cast("long").alias("state"), F.trim(field(i, 4)).cast("double").cast("long").alias("cp"), "length")


def union_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables with dataset_id; they must have the same columns."""
    if len({tuple(sorted(t.columns)) for t in tables.values()}) > 1:
        raise ValueError("the datasets have different columns")
    return reduce(DataFrame.unionByName, [t.withColumn("dataset_id", F.lit(k)) for k, t in tables.items()])


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(track(KEYS))).where(F.col("_r") <= n).drop("_r")
