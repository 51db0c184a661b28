"""Exports (K). Each export is a table; write_* puts it into files by Spark's own writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS, track
from ..functions.ranks import numbered
from ..operators.annotate import track_numbers


def segmenter_input(df: DataFrame, most: int = 200) -> DataFrame:
    """traj_idx, frame (row from 0), x, y relative to the first point; the first rows of each track."""
    w = track()
    d = df.withColumns({"_r": F.row_number().over(w) - 1, "_x": F.col("x_px") - F.first("x_px").over(w), "_y": F.col("y_px") - F.first("y_px").over(w)})
    return d.where(F.col("_r") < most).join(track_numbers(df), list(KEYS)).select("traj_idx", F.col("_r").alias("frame"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def training_rows(df: DataFrame, features: list[str], label: str = "class_label") -> DataFrame:
    """One row for each track and split: arrays of feature vectors and labels in the order of frames."""
    a = df.groupBy("split", *KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", F.array(*features).alias("v"), F.col(label).alias("l")))).alias("a"))
    return a.select("split", *KEYS, F.transform("a", lambda x: x["v"]).alias("data"), F.transform("a", lambda x: x["l"]).alias("labels"))


def diffusion_raw(d: DataFrame, classes: Sequence[int]) -> DataFrame:
    """row, class_1, ...: a column of diffusion coefficients for each class, in the order of tracks, shorter ones ending in nulls."""
    n = numbered(d.select("class_label", *KEYS, "d"), ["class_label"], list(KEYS), "row")
    return n.groupBy("row").pivot("class_label", list(classes)).agg(F.max("d")).select("row", *[F.col(str(k)).alias(f"class_{k}") for k in classes])


def diffusion_binned(h: DataFrame, classes: Sequence[int], width: float) -> DataFrame:
    """bin, centre, class_1, ...: counts of a histogram by class side by side."""
    low = h.groupBy("bin").agg((F.min("low") + width / 2).alias("centre"))
    wide = h.groupBy("bin").pivot("class_label", list(classes)).agg(F.sum("n"))
    return low.join(wide, "bin").select("bin", "centre", *[F.coalesce(str(k), F.lit(0)).alias(f"class_{k}") for k in classes])


def event_matrix(aligned: DataFrame) -> DataFrame:
    """event_id, rel, value: one event for each (cell, mol, event frame)."""
    return aligned.select(F.concat_ws("-", *[F.col(c).cast("string") for c in (*KEYS, "event")]).alias("event_id"), "rel", "value")


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_training(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A folder for each split; JSON objects with data and labels, or CSV with both as JSON text."""
    if kind == "json":
        rows.write.partitionBy("split").json(path)
    else:
        rows.withColumns({"data": F.to_json("data"), "labels": F.to_json("labels")}).write.partitionBy("split").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str, record: dict) -> None:
    """The model, and beside it a JSON record of its features, scaling, classes and settings."""
    model.write().overwrite().save(path)
    SparkSession.getActiveSession().createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-record")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(path), json.loads(spark.read.text(f"{path}-record").first()["value"])
