"""Streaming forms of linking and arrivals (R), by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spatial import Linker
from ..params import DEFAULT

#: The second of event time that frame 0 stands for; a frame is a second. Watermarks start at second 0, so frames may be negative.
ORIGIN = 1_000_000_000
#: Track ids of a stream: the first frame, then the number of the point in it.
SHIFT = 32
#: Numbers of a cell's state: open tracks (id, x, y, last frame) and waiting points (frame, x, y).
_KINDS = ("<i8", "<f8", "<f8", "<i8", "<i8", "<f8", "<f8")


def link_stream(points: DataFrame, mem: int = DEFAULT.mem_param, dist: float = DEFAULT.link_dist, delay: int = 10) -> DataFrame:
    """points (cell_id int, frame int, x_px, y_px) of a stream with mol_id, in append mode.

    Rows may come in any order up to `delay` frames behind the newest frame: a cell's rows wait in its state until the watermark has passed their frame, and are
    then linked as link_tracks() does. A timer on event time wakes a cell for its next waiting frame, or ends its state once mem + 1 frames without
    points are past, so silent cells cost nothing. A track's id is made of its first frame and the number of its first point there, so it needs no state and grows
    in the order of starts. Later rows than that are dropped by the watermark and counted: late_rows().
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, xs, ys, last, frames, wx, wy = (np.frombuffer(v, k) for v, k in zip(state.get if state.exists else (b"",) * 7, _KINDS, strict=True))
        rows = pd.DataFrame({"frame": frames, "x_px": wx, "y_px": wy})
        if not state.hasTimedOut:
            rows = pd.concat([rows, *[p[["frame", "x_px", "y_px"]] for p in parts]], ignore_index=True)
        until = state.getCurrentWatermarkMs() // 1000 - ORIGIN  # frames up to this one are complete
        ready = rows[rows["frame"] <= until].sort_values(["frame", "x_px", "y_px"], kind="stable")
        waiting = rows[rows["frame"] > until]
        linker, found = Linker(mem, dist, list(zip(ids.tolist(), xs.tolist(), ys.tolist(), last.tolist(), strict=True))), []
        for frame, g in ready[["frame", "x_px", "y_px"]].groupby("frame", sort=True):
            found += linker.frame(int(frame), g[["x_px", "y_px"]].to_numpy(), lambda k, f=int(frame): (f << SHIFT) + k)
        open_ = [t for t in linker.open if until - t[3] < mem + 1]
        if not len(waiting) and not open_:
            if state.exists:
                state.remove()
        else:
            wake = int(waiting["frame"].min()) if len(waiting) else max(t[3] for t in open_) + mem + 1
            columns = [*([t[c] for t in open_] for c in range(4)), *(waiting[c] for c in ("frame", "x_px", "y_px"))]
            state.update(tuple(np.asarray(v, k).tobytes() for v, k in zip(columns, _KINDS, strict=True)))
            state.setTimeoutTimestamp((wake + ORIGIN) * 1000)
        if len(ready):
            yield ready.assign(cell_id=key[0], mol_id=found)[["cell_id", "frame", "x_px", "y_px", "mol_id"]].astype({"cell_id": "int32", "frame": "int32", "mol_id": "int64"})

    timed = points.withColumn("at", F.timestamp_seconds(F.col("frame") + ORIGIN)).withWatermark("at", f"{delay} seconds")
    out = "cell_id int, frame int, x_px double, y_px double, mol_id long"
    kept = "ids binary, xs binary, ys binary, last binary, frames binary, wx binary, wy binary"  # Spark hands the state over with every batch of rows, so it is bytes
    return timed.groupBy("cell_id").applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark of a query and weren't used, over the batches that it remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def arrivals(rows: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """key, arrived: the first time of each key, in append mode; a key that is silent for `gap` arrives again.

    Rows may be `delay` late, in any order: a key's rows are one session window, which starts at its first row and goes out once the watermark is past its end.
    """
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.session_window(at, gap).alias("_s"), F.col(key)).agg(F.count("*").alias("_n")).select(key, F.col("_s.start").alias("arrived"))


def arrival_counts(arrived: DataFrame, width: str, delay: str) -> DataFrame:
    """start, n: a stream of arrivals() counted in tumbling windows, in append mode; delay is the longest that an arrival waits for its session's end."""
    timed = arrived.withWatermark("arrived", delay)
    return timed.groupBy(F.window("arrived", width).alias("_w")).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), "n")
