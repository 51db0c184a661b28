"""Filters and preparation of tracks (F). Tracks are rows (cell_id, mol_id, frame, ...); a track's span is its first to last frame.

What sweeps over all tracks of a cell does so in ranges of frames, with sums carried from one to the next, so a recording of any size takes many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, track, whole
from ..functions.ranks import numbered, running


def spans(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("n"))


def renumber(df: DataFrame) -> DataFrame:
    """Molecules of a cell numbered 1.. in the order of (first frame, id)."""
    firsts = df.groupBy(*KEYS).agg(F.min("frame").alias("_f"))
    new = numbered(firsts, ["cell_id"], ["_f", "mol_id"], "new_id").drop("_f")
    return df.join(new, list(KEYS)).withColumn("mol_id", F.col("new_id").cast("long")).drop("new_id")


def drop_short(df: DataFrame, least: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).where(F.col("_n") >= least).drop("_n")


def conflicts(df: DataFrame, buffer: int) -> DataFrame:
    """Tracks whose first or last frame lies strictly inside the buffered span of another track of the cell.

    A sweep over span ends instead of a join of all pairs: a frame lies in n spans if n opened and didn't close before it.
    """
    s = spans(df)
    marks = s.select("cell_id", F.explode(F.array(F.struct((F.col("lo") - buffer).alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("d")), F.struct((F.col("hi") + buffer).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("d")))).alias("e")).select("cell_id", "e.*", F.lit(None).cast("long").alias("mol_id"))
    asked = s.select("cell_id", "mol_id", F.explode(F.array("lo", "hi")).alias("at")).select("cell_id", "at", F.lit(1).alias("kind"), F.lit(0).alias("d"), "mol_id")
    # at one frame: spans that end there close first, then questions, then spans that start there open: both ends are strict
    swept = running(marks.unionByName(asked), ["cell_id"], ["at", "kind"], {"open": "d"}).where("kind = 1")
    # with a buffer a track's own span holds both its ends, without one neither
    return swept.where(F.col("open") > (1 if buffer > 0 else 0)).select("cell_id", "mol_id").distinct()


def eliminate_conflicts(df: DataFrame, buffer: int, least: int) -> DataFrame:
    return drop_short(df.join(conflicts(df, buffer), list(KEYS), "left_anti"), least)


def truncate_overlaps(df: DataFrame) -> DataFrame:
    """Without the rows whose frame lies in the spans of two or more tracks of the cell, by a sweep over span ends."""
    s = spans(df)
    edges = s.select("cell_id", F.explode(F.array(F.struct(F.col("lo").alias("frame"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("frame"), F.lit(-1).alias("d")))).alias("e")).select("cell_id", "e.*")
    edges = edges.groupBy("cell_id", "frame").agg(F.sum("d").alias("d"))
    # each frame of a cell is asked once, whatever a row holds besides
    asked = df.select("cell_id", "frame").distinct().select("cell_id", "frame", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_d"))
    marked = asked.unionByName(edges.select("cell_id", "frame", F.lit(0).alias("_kind"), F.col("d").alias("_d")))
    alone = running(marked, ["cell_id"], ["frame", "_kind"], {"_open": "_d"}).where("_kind = 1 AND _open < 2")
    return df.join(alone, ["cell_id", "frame"], "left_semi").select(df.columns)


def split_gaps(df: DataFrame, mem: int) -> DataFrame:
    """Tracks are split where the frame jumps by more than mem+1; later pieces get new ids above the largest of the cell."""
    jump = F.when(F.col("frame") - F.lag("frame").over(track()) > mem + 1, 1).otherwise(0)
    cut = df.withColumn("_j", jump).withColumn("_piece", F.sum("_j").over(track().rowsBetween(Window.unboundedPreceding, 0)))
    later = cut.where("_piece > 0").select(*KEYS, "_piece").distinct()
    later = numbered(later, ["cell_id"], ["mol_id", "_piece"], "_rank")
    top = df.groupBy("cell_id").agg(F.max("mol_id").alias("_top"))
    new = later.join(top, "cell_id").select(*KEYS, "_piece", (F.col("_top") + F.col("_rank")).alias("_new"))
    return cut.join(new, [*KEYS, "_piece"], "left").withColumn("mol_id", F.coalesce("_new", "mol_id")).drop("_j", "_piece", "_new")


def truncation_filter(df: DataFrame, mem: int, least: int) -> DataFrame:
    return renumber(drop_short(split_gaps(truncate_overlaps(df), mem), least))


def foreign_points(df: DataFrame, all_locs: DataFrame, tolerance: int) -> DataFrame:
    """Without tracks in whose span more than `tolerance` localisations of the cell belong to other tracks or none.

    Counts of rows up to a frame are running sums over the cell, so that no span meets every localisation in it.
    """
    s = spans(df)
    counts = all_locs.groupBy("cell_id", "frame").agg(F.count("*").alias("k"))
    asked = s.select("cell_id", "mol_id", F.explode(F.array(F.struct((F.col("lo") - 1).alias("frame"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("frame"), F.lit(1).alias("sign")))).alias("e")).select("cell_id", "mol_id", "e.*")
    both = counts.select("cell_id", "frame", F.col("k"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("mol_id"), F.lit(0).alias("sign")).unionByName(asked.select("cell_id", "frame", F.lit(0).cast("long").alias("k"), F.lit(1).alias("kind"), "mol_id", "sign"))
    inside = running(both, ["cell_id"], ["frame", "kind"], {"c": "k"}).where("kind = 1").groupBy(*KEYS).agg(F.sum(F.col("c") * F.col("sign")).alias("inside"))
    keep = inside.join(s, list(KEYS)).where(F.col("inside") - F.col("n") <= tolerance).select(*KEYS)
    return df.join(keep, list(KEYS), "left_semi")


def cells_with_tracks(cells: DataFrame, df: DataFrame) -> DataFrame:
    return cells.join(df.select("cell_id").distinct(), "cell_id", "left_semi")


def excluded_rows(features: Sequence[str]) -> tuple[int, int]:
    """How many rows at the start and the end of a track have no meaning for these features."""
    start = {"step_nm": 1, "time_step": 1, "image_angle": 1, "cell_angle": 1, "step_p1": 1, "turn_angle": 2, "step_m1": 2, "step_m2": 3}
    return max((start.get(f, 0) for f in features), default=0), int("step_p1" in features)


def crop(df: DataFrame, start: int, end: int) -> DataFrame:
    w, n = track(), F.count("*").over(whole())
    return df.withColumns({"_r": F.row_number().over(w), "_n": n}).where((F.col("_r") > start) & (F.col("_r") <= F.col("_n") - end)).drop("_r", "_n")


def fully_labelled(df: DataFrame, label: str = "class_label") -> DataFrame:
    """Tracks without an unlabelled row (null, or not above 0)."""
    bad = F.max(F.when(F.coalesce(F.col(label), F.lit(-1)) <= 0, 1).otherwise(0)).over(Window.partitionBy(*KEYS))
    return df.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def with_truth_only(df: DataFrame, truth: DataFrame, least: int) -> DataFrame:
    """Rows that have a truth label for (cell, mol, frame), then tracks of at least so many rows."""
    return drop_short(df.join(truth.select(*KEYS, "frame").distinct(), [*KEYS, "frame"], "left_semi"), least)


def cells_by_length(df: DataFrame, cells: DataFrame, low_um: float, high_um: float, px_scale: float) -> DataFrame:
    chosen = cells.where((F.col("length_px") * px_scale / 1000).between(low_um, high_um)).select("cell_id")
    return df.join(chosen, "cell_id", "left_semi")


def event_filter(events: DataFrame, kind: str) -> DataFrame:
    """Events by truncation: all, full, any, single, double."""
    left, right = F.col("left_truncated"), F.col("right_truncated")
    keep = {"all": F.lit(True), "full": ~left & ~right, "any": left | right, "single": left != right, "double": left & right}
    return events.where(keep[kind])


def annotated_tracks(df: DataFrame, annotation: DataFrame) -> DataFrame:
    """Tracks that the annotation labels fully."""
    return df.join(fully_labelled(annotation).select(*KEYS).distinct(), list(KEYS), "left_semi")


def without_zeros(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(f) == 0, F.lit(False)) for f in features]))


def with_coordinates(df: DataFrame, columns: Sequence[str] = ("x_px", "y_px")) -> DataFrame:
    return reduce(lambda d, c: d.where(F.col(c).isNotNull() & ~F.isnan(c)), columns, df)
