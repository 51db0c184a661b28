"""Annotations: comparison, consensus and application of labels (A). Annotations are rows (source, cell_id, mol_id, frame, class_label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, track
from ..params import DEFAULT, Params
from .msd import runs


def common_tracks(ann: DataFrame, sources: int) -> DataFrame:
    return ann.select("source", *KEYS).distinct().groupBy(*KEYS).agg(F.count("*").alias("k")).where(F.col("k") == sources).select(*KEYS)


def common_labelled_tracks(ann: DataFrame, sources: int) -> DataFrame:
    whole = ann.groupBy("source", *KEYS).agg(F.min(F.coalesce("class_label", F.lit(-1))).alias("least")).where("least > 0")
    return common_tracks(whole, sources)


def confusion(truth: DataFrame, model: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """actual, predicted, n over the tracks that both have with equal length, rows matched by position, cropped at both ends."""

    def rows(d: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*KEYS)
        return d.select(*KEYS, F.row_number().over(track()).alias("row"), F.count("*").over(w).alias("n_rows"), F.col("class_label").alias(name))

    j = rows(truth, "actual").join(rows(model, "predicted"), [*KEYS, "row", "n_rows"])
    return j.where((F.col("row") > start) & (F.col("row") <= F.col("n_rows") - end)).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def class_metrics(c: DataFrame) -> DataFrame:
    """class, accuracy, precision, recall, f1, jaccard of a confusion table; undefined ones are 0. The table has a few rows."""
    a = c.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("act"), F.lit(0).cast("long").alias("pre")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("act"), F.col("n").alias("pre")))).alias("e")).select("e.*")
    s = a.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("act").alias("act"), F.sum("pre").alias("pre"))
    s = s.join(F.broadcast(c.agg(F.sum("n").alias("all"))), F.lit(True))
    zero = F.lit(0.0)
    return s.select(
        "class",
        ((F.col("all") - F.col("act") - F.col("pre") + 2 * F.col("tp")) / F.col("all")).alias("accuracy"),
        F.coalesce(F.try_divide("tp", "pre"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "act"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("pre") + F.col("act")), zero).alias("f1"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("pre") + F.col("act") - F.col("tp")), zero).alias("jaccard"),
    )


def macro_metrics(c: DataFrame) -> DataFrame:
    m = class_metrics(c).agg(*[F.avg(x).alias(x) for x in ("precision", "recall", "f1", "jaccard")])
    a = c.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return a.join(m, F.lit(True))


def changepoints(d: DataFrame, label: str = "class_label") -> DataFrame:
    """cell, mol, row (the first of the new state), from, to, gap to the neighbouring changepoints."""
    r = d.select(*KEYS, F.row_number().over(track()).alias("row"), F.col(label).alias("to"), F.lag(label).over(track()).alias("from")).where("from <> to")
    w = Window.partitionBy(*KEYS).orderBy("row")
    return r.withColumn("gap", F.least(F.col("row") - F.lag("row").over(w), F.lead("row").over(w) - F.col("row")))


def changepoint_errors(truth: DataFrame, model: DataFrame, min_sep: int, max_err: int) -> DataFrame:
    """One row for each true changepoint not closer than min_sep to another: err (signed rows to the nearest like one, or max_err), paired."""
    t = changepoints(truth).where(F.col("gap").isNull() | (F.col("gap") >= min_sep))
    m = changepoints(model).select(*KEYS, "from", "to", F.col("row").alias("found"))
    near = t.join(m, [*KEYS, "from", "to"], "left").groupBy(*KEYS, "row", "from", "to").agg(F.min(F.when(F.col("found").isNotNull(), F.struct(F.abs(F.col("found") - F.col("row")).alias("d"), F.col("found")))).alias("b"))
    ok = F.col("b").isNotNull() & (F.col("b")["d"] <= max_err)
    return near.select(*KEYS, "row", "from", "to", F.when(ok, F.col("b")["found"] - F.col("row")).otherwise(max_err).alias("err"), F.coalesce(ok, F.lit(False)).alias("paired"))


def changepoint_summary(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("n"), F.sum(F.col("paired").cast("int")).alias("paired"), F.avg(F.abs("err")).alias("mean_abs"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))


def two_class_agreement(human: DataFrame, model: DataFrame) -> DataFrame:
    """tp, tn, fp, fn and shares of class 1 against the rest; a miss counts as false positive if the model says 1, else as false negative.

    Rows of a track are compared by their position in it, up to the end of the shorter of the two.
    """
    w = track()
    h = human.select(*KEYS, F.row_number().over(w).alias("row"), F.col("class_label").alias("h"))
    j = h.join(model.select(*KEYS, F.row_number().over(w).alias("row"), F.col("class_label").alias("m")), [*KEYS, "row"])
    same = F.col("h") == F.col("m")

    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    s = j.agg(count(same & (F.col("m") == 1)).alias("tp"), count(same & (F.col("m") != 1)).alias("tn"), count(~same & (F.col("m") == 1)).alias("fp"), count(~same & (F.col("m") != 1)).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    s = s.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "specificity": F.try_divide(tn, tn + fp)})
    return s.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def attach_truth(df: DataFrame, truth: DataFrame, by_mol: bool = False) -> DataFrame:
    """df with truth_label by (cell, frame), or with the molecule too; of several truths the largest (mol, label) counts."""
    by = [*KEYS, "frame"] if by_mol else ["cell_id", "frame"]
    one = truth.groupBy(*by).agg(F.max(F.struct("mol_id", "class_label") if not by_mol else F.struct("class_label")).alias("_t"))
    return df.join(one, by, "left").withColumn("truth_label", F.col("_t")["class_label"]).drop("_t")


def shift_truth(df: DataFrame, label: str = "class_label") -> DataFrame:
    return df.withColumn("shifted", F.coalesce(F.lag(label).over(track()), F.col(label)))


def consensus(scores: DataFrame) -> DataFrame:
    """cell, mol, row, label, confidence, windows from (cell, mol, start, offset, class, p): summed by row and class, ties to the lower class."""
    s = scores.select(*KEYS, (F.col("start") + F.col("offset")).alias("row"), "class", "p", F.lit(1).cast("long").alias("windows"))
    return consensus_of_sums(s)


def consensus_of_sums(sums: DataFrame) -> DataFrame:
    """consensus() of (cell, mol, row, class, p, windows) that hold sums over some of the windows."""
    s = sums.groupBy(*KEYS, "row", "class").agg(F.sum("p").alias("p"), F.sum("windows").alias("windows"))
    return s.groupBy(*KEYS, "row").agg(F.max_by("class", F.struct(F.col("p"), -F.col("class"))).alias("label"), F.try_divide(F.max("p"), F.sum("p")).alias("confidence"), F.max("windows").alias("windows"))


def apply_spans(df: DataFrame, marks: DataFrame) -> DataFrame:
    """df (with row) labelled by marks (cell, mol, pos, class, seq): a mark labels the rows after the previous mark up to pos; rows beyond all marks stay null.

    marks are joined by a running fill, not by a range: each row takes the class of the first mark at or after it, the latest seq winning at one pos.
    """
    rows = df.withColumn("row", F.row_number().over(track()))
    n = df.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    # a mark beyond the end of its track labels up to the end, unless an earlier one does
    at = marks.join(n, list(KEYS)).withColumn("row", F.least("pos", "_n").cast("int"))
    one = at.groupBy(*KEYS, "row").agg(F.min_by("class", F.struct("pos", -F.col("seq"))).alias("_class"))
    w = Window.partitionBy(*KEYS).orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    return rows.join(one, [*KEYS, "row"], "left").withColumn("label", F.first("_class", ignorenulls=True).over(w)).drop("_class")


def track_status(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(*KEYS).agg((F.count(label) == F.count("*")).alias("complete"), F.count(label).alias("labelled_rows"))


def undo_last(df: DataFrame, label: str = "class_label") -> DataFrame:
    """The last labelled run of each track made null."""
    r = runs(df, label)
    last = F.max(F.when(F.col(label).isNotNull(), F.col("run"))).over(Window.partitionBy(*KEYS))
    return r.withColumn("_last", last).withColumn(label, F.when(F.col("run") == F.col("_last"), None).otherwise(F.col(label))).drop("run", "_last")


def track_numbers(df: DataFrame) -> DataFrame:
    """cell, mol, traj_idx: tracks numbered from 0 in the order of (cell, mol); ranked within cells, and one running sum over cells."""
    tracks = df.select(*KEYS).distinct()
    cells = tracks.groupBy("cell_id").agg(F.count("*").alias("k"))
    base = cells.withColumn("base", F.sum("k").over(Window.orderBy("cell_id")) - F.col("k")).drop("k")
    own = F.row_number().over(Window.partitionBy("cell_id").orderBy("mol_id"))
    return tracks.withColumn("own", own).join(base, "cell_id").select(*KEYS, (F.col("base") + F.col("own") - 1).alias("traj_idx"))


def external_labels(df: DataFrame, segments: DataFrame, thresholds: list[float] | None = None, cap: int = 200) -> DataFrame:
    """df with `label` from segments (traj_idx, seg, k, state, cp, length), tracks numbered densely from 0; rows past cap have none.

    A segment reaches row min(cp + 1, length), 0-based cp, and its label is its state: of several that reach the end of a short track the first counts. With
    thresholds the label is the number of them not above k plus 1, and of segments whose cp is the track's length or more the last counts.
    """
    numbers = track_numbers(df)
    s = segments.join(numbers, "traj_idx").withColumn("_len", F.least("length", F.lit(cap)))
    inside = F.col("cp") < F.col("_len")
    if thresholds is None:
        value, pos, first = F.col("state"), F.least(F.col("cp") + 1, F.col("_len")), -F.col("seg")
    else:
        value = sum([F.when(F.col("k") >= t, 1).otherwise(0) for t in thresholds], F.lit(1))
        pos, first = F.when(inside, F.col("cp") + 1).otherwise(F.col("_len")), F.when(inside, -F.col("seg")).otherwise(F.col("seg"))
    marks = s.select(*KEYS, pos.alias("pos"), value.alias("class"), F.struct(inside if thresholds is not None else F.lit(True), first).alias("order"))
    one = marks.where(F.col("pos") >= 1).groupBy(*KEYS, "pos").agg(F.max_by("class", "order").alias("class"), F.lit(0).alias("seq"))
    return apply_spans(df, one).withColumn("label", F.when(F.col("row") <= cap, F.col("label")))


def initialise(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One pending annotation for each track: rows, duration (s), no label."""
    return df.groupBy(*KEYS).agg(F.count("*").alias("rows"), (F.count("*") / p.frame_rate).alias("duration")).withColumns({"status": F.lit("pending"), "sequence": F.lit(None).cast("string")})


def inspect(ann: DataFrame, df: DataFrame, value: str, cell_id: int, mol_id: int, sources: list[str], p: Params = DEFAULT) -> DataFrame:
    """frame, time, value and the label of each source for one track."""
    one = (F.col("cell_id") == cell_id) & (F.col("mol_id") == mol_id)
    labels = ann.where(one).groupBy("frame").pivot("source", sources).agg(F.max("class_label"))
    return df.where(one).select("frame", (F.col("frame") / p.frame_rate).alias("time"), value).join(labels, "frame", "left")
