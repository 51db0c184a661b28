"""States, transitions and events of labelled tracks (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, track, whole
from ..functions.ranks import quantiles
from ..params import DEFAULT, Params
from .msd import runs
from .prepare import fully_labelled


def state_sequence(df: DataFrame, label: str = "class_label") -> DataFrame:
    """cell, mol, states (array of the labels in order without repeats and zeros) and their text."""
    labelled = df.where(F.col(label) != 0)
    change = labelled.withColumn("_p", F.lag(label).over(track())).where(F.col("_p").isNull() | (F.col("_p") != F.col(label)))
    out = change.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", label))).alias("_a"))
    states = F.transform("_a", lambda x: x[label])
    return out.select(*KEYS, states.alias("states"), F.array_join(states.cast("array<string>"), "").alias("sequence"))


def state_times(df: DataFrame, by: str = "rows", label: str = "class_label", p: Params = DEFAULT) -> DataFrame:
    """state, time (s), share: rows over the frame rate ('rows'), or frames to the next row ('elapsed'), over fully labelled tracks."""
    d = fully_labelled(df, label)
    amount = F.lit(1) if by == "rows" else F.coalesce(F.lead("frame").over(track()) - F.col("frame"), F.lit(0))
    t = d.withColumn("_k", amount).groupBy(F.col(label).alias("state")).agg((F.sum("_k") / p.frame_rate).alias("time"))
    return t.withColumn("share", F.try_divide("time", F.sum("time").over(Window.partitionBy(F.lit(0)))))


def transitions(df: DataFrame, label: str = "class_label", p: Params = DEFAULT) -> DataFrame:
    """from, to, n, rate (per second in `from`) for every ordered pair of different states that occur, zeros included."""
    d = fully_labelled(df, label)
    moved = d.withColumn("_p", F.lag(label).over(track())).where(F.col("_p") != F.col(label)).groupBy(F.col("_p").alias("from"), F.col(label).alias("to")).agg(F.count("*").alias("n"))
    times = state_times(df, label=label, p=p)
    a, b = times.select(F.col("state").alias("from"), "time"), times.select(F.col("state").alias("to"))
    grid = a.join(b, F.col("from") != F.col("to"))  # states by states: a handful
    return grid.join(moved, ["from", "to"], "left").select("from", "to", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), "time").alias("rate"))


def summary(df: DataFrame, before: DataFrame, label: str = "class_label", p: Params = DEFAULT) -> DataFrame:
    """One row: molecules before filtering, left, fully labelled, progress (%), observation time and experiment time (s)."""
    tracks = df.groupBy(*KEYS).agg(F.min(F.coalesce(F.col(label), F.lit(-1))).alias("least"), F.count("*").alias("rows"), F.max("frame").alias("last"))
    a = tracks.agg(F.count("*").alias("molecules"), F.sum(F.when(F.col("least") > 0, 1).otherwise(0)).alias("labelled"), (F.sum("rows") / p.frame_rate).alias("observation_time"), (F.max("last") / p.frame_rate).alias("experiment_time"))
    b = before.select(*KEYS).distinct().agg(F.count("*").alias("molecules_before"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("progress", F.try_divide(F.col("labelled") * 100.0, F.col("molecules")))


def observation_times(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return df.groupBy(*KEYS).agg((F.count("*") / p.frame_rate).alias("observed"))


def arrivals(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.min("frame").alias("first_frame")).withColumn("first_time", F.col("first_frame") / p.frame_rate)


def arrival_histogram(df: DataFrame, width: float, p: Params = DEFAULT) -> DataFrame:
    return arrivals(df, p).groupBy(F.floor(F.col("first_time") / width).alias("bin")).agg(F.count("*").alias("n"))


def events(df: DataFrame, label: str = "class_label", strict: bool = False, p: Params = DEFAULT) -> DataFrame:
    """One row for each run of a state: cell, mol, run, state, first_frame, last_frame, duration (s), left_truncated, right_truncated.

    A run of one row lasts one frame. strict: a run of one row lasts as long as the first time step of its track, and one on the last row is dropped.
    """
    r = runs(fully_labelled(df, label), label)
    r = r.withColumns({"_lo": F.first("frame").over(whole()), "_hi": F.last("frame").over(whole()), "_dt": F.nth_value("frame", 2).over(whole())})
    e = r.groupBy(*KEYS, "run", F.col(label).alias("state")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("rows"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_dt").alias("_dt"))
    one = F.col("rows") == 1
    length = F.when(one, (F.col("_dt") - F.col("_lo")) if strict else F.lit(1)).otherwise(F.col("last_frame") - F.col("first_frame"))
    e = e.withColumns({"duration": length / p.frame_rate, "left_truncated": F.col("first_frame") == F.col("_lo"), "right_truncated": F.col("last_frame") == F.col("_hi")})
    if strict:
        e = e.where(~(one & F.col("right_truncated")))
    return e.drop("_lo", "_hi", "_dt", "rows")


def state_events(df: DataFrame, state: int, label: str = "class_label", p: Params = DEFAULT) -> DataFrame:
    return events(df, label, p=p).where(F.col("state") == state)


def _binary_runs(df: DataFrame, state: int, label: str) -> DataFrame:
    inside = df.withColumn("_in", F.when(F.col(label) == state, 1).otherwise(0))
    r = runs(inside, "_in")
    e = r.groupBy(*KEYS, "run").agg(F.max("_in").alias("inside"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    w = Window.partitionBy(*KEYS).orderBy("run")
    return e.withColumns({"next_a": F.lead("a").over(w), "next_b": F.lead("b").over(w), "prev_a": F.lag("a").over(w), "prev_b": F.lag("b").over(w)})


def exits(df: DataFrame, state: int, label: str = "class_label") -> DataFrame:
    """cell, mol, start of the stay, frame of the exit (first row outside), end of the stretch outside."""
    e = _binary_runs(df, state, label).where("inside = 1 AND next_a IS NOT NULL")
    return e.select(*KEYS, F.col("a").alias("start"), F.col("next_a").alias("exit"), F.col("next_b").alias("end"))


def entrances(df: DataFrame, state: int, label: str = "class_label") -> DataFrame:
    """cell, mol, start of the stretch outside, frame of the entrance (first row inside), end of the stay."""
    e = _binary_runs(df, state, label).where("inside = 1 AND prev_a IS NOT NULL")
    return e.select(*KEYS, F.col("prev_a").alias("start"), F.col("a").alias("entrance"), F.col("b").alias("end"))


def fill_gaps(df: DataFrame, values: list[str], label: str = "class_label") -> DataFrame:
    """A row for each frame of a track's span: values of missing frames are null, the label is carried forward."""
    spans = df.groupBy(*KEYS).agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    grid = spans.select(*KEYS, F.explode(F.sequence("_lo", "_hi")).alias("frame"))
    full = grid.join(df.select(*KEYS, "frame", label, *values), [*KEYS, "frame"], "left")
    return full.withColumn(label, F.last(label, ignorenulls=True).over(track().rowsBetween(Window.unboundedPreceding, 0)))


def aligned(df: DataFrame, value: str, state: int, kind: str = "exit", label: str = "class_label") -> DataFrame:
    """cell, mol, event frame, rel, value: gap-filled rows of the stay and the stretch outside it, relative to the event."""
    e = exits(df, state, label).withColumnRenamed("exit", "event") if kind == "exit" else entrances(df, state, label).withColumnRenamed("entrance", "event")
    rows = fill_gaps(df, [value], label).select(F.col("cell_id").alias("_c"), F.col("mol_id").alias("_m"), "frame", value)
    j = e.join(rows, (F.col("cell_id") == F.col("_c")) & (F.col("mol_id") == F.col("_m")) & F.col("frame").between(F.col("start"), F.col("end")))
    return j.select(*KEYS, "event", (F.col("frame") - F.col("event")).alias("rel"), F.col(value).alias("value"))


def profile(a: DataFrame) -> DataFrame:
    """By relative frame: n, mean, median, std, var, sem of the values, zeros being missing."""
    d = a.select("rel", F.nullif(F.col("value"), F.lit(0.0)).alias("v"))
    v = F.col("v")
    out = d.groupBy("rel").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))
    middle = quantiles(d, ["rel"], "v", [0.5]).select("rel", F.col("v").alias("median"))
    return out.join(middle, "rel", "left").select("rel", "n", "mean", "median", "std", "var", "sem")


def trimmed(a: DataFrame) -> DataFrame:
    """Without the relative frames at either end that hold no value but zero."""
    ends = a.where(F.col("value") != 0).agg(F.min("rel").alias("_lo"), F.max("rel").alias("_hi"))
    return a.join(F.broadcast(ends), F.col("rel").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def profile_histogram(a: DataFrame, width: float, low: int, high: int) -> DataFrame:
    """rel, bin, share: distribution of the values at each relative frame of a range."""
    n = a.where(F.col("rel").between(low, high) & F.col("value").isNotNull()).groupBy("rel", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rel"))).drop("n")


def count_changes(df: DataFrame, label: str = "class_label") -> DataFrame:
    """state, entrances, exits over all tracks."""
    d = df.withColumn("_p", F.lag(label).over(track())).where(F.col("_p") != F.col(label))
    both = d.select(F.explode(F.array(F.struct(F.col(label).alias("state"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("_p").alias("state"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    return both.groupBy("state").agg(F.sum("i").alias("entrances"), F.sum("o").alias("exits"))


def longest_mixed_track(df: DataFrame, state: int, label: str = "class_label") -> DataFrame:
    """The largest number of frames of a fully labelled track that has the state and another."""
    t = fully_labelled(df, label).groupBy(*KEYS).agg((F.max("frame") - F.min("frame") + 1).alias("n"), F.max(F.when(F.col(label) == state, 1).otherwise(0)).alias("has"), F.max(F.when(F.col(label) != state, 1).otherwise(0)).alias("other"))
    return t.where("has = 1 AND other = 1").agg(F.max("n").alias("longest"))


def dwell_histogram(e: DataFrame, state: int, width: float) -> DataFrame:
    return e.where(F.col("state") == state).groupBy(F.floor(F.col("duration") / width).alias("bin")).agg(F.count("*").alias("n"))


def step_profile(steps: DataFrame, width: float, first: int | None = None) -> DataFrame:
    """Histogram of step sizes, of all steps or of the first so many of each track."""
    row = F.row_number().over(track())
    s: Column = F.col("_r") > 1
    if first is not None:
        s = s & (F.col("_r") <= first + 1)
    return steps.withColumn("_r", row).where(s).groupBy(F.floor(F.col("step_nm") / width).alias("bin")).agg(F.count("*").alias("n"))
