"""Training sets, windows, scoring and evaluation (L)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, keyed, track
from ..functions.storage import written
from . import annotate, stats
from .prepare import crop, fully_labelled


def scaling(df: DataFrame, features: Sequence[str], kind: str = "zscore") -> DataFrame:
    """feature, shift, scale: mean and sample deviation, minimum and range, or 0 and 1. A constant feature has scale 1."""

    def of(f: str) -> tuple[Column, Column]:
        if kind == "zscore":
            return F.avg(f), F.stddev_samp(f)
        if kind == "minmax":
            return F.min(f), F.max(f) - F.min(f)
        return F.lit(0.0), F.lit(1.0)

    parts = [F.struct(F.lit(f).alias("feature"), of(f)[0].cast("double").alias("shift"), F.coalesce(F.nullif(of(f)[1].cast("double"), F.lit(0.0)), F.lit(1.0)).alias("scale")) for f in features]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def scale(df: DataFrame, parameters: DataFrame, features: Sequence[str], invert: bool = False) -> DataFrame:
    """df with scaled features; parameters are a row a feature."""
    p = F.broadcast(parameters.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("shift", "scale").alias("v")))).alias("_m")))
    d = df.join(p, F.lit(True))
    v = lambda f: F.col("_m")[f]
    return d.withColumns({f: F.col(f) * v(f)["scale"] + v(f)["shift"] if invert else (F.col(f) - v(f)["shift"]) / v(f)["scale"] for f in features}).drop("_m")


def training_table(df: DataFrame, features: Sequence[str], kind: str = "zscore", start: int = 0, end: int = 0, label: str = "class_label") -> DataFrame:
    d = crop(fully_labelled(df, label), start, end).select(*KEYS, "frame", *features, label)
    return scale(d, scaling(d, features, kind), features)


def order_by_hash(df: DataFrame, seed: int, by: Sequence[str] = KEYS) -> DataFrame:
    """df with shuffle_key, a seeded hash of a row's molecule (or of more columns); sorting by it shuffles, alike on every run."""
    return df.withColumn("shuffle_key", keyed(seed, *by))


def split(df: DataFrame, shares: dict[str, float], seed: int, by: Sequence[str] = KEYS) -> DataFrame:
    """df with split, by a digest of the key and seed: all rows of a key are in one split; shares are met in expectation."""
    u = F.conv(F.substring(keyed(seed, *by), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    at, name = 0.0, None
    total = sum(shares.values())
    for k, v in shares.items():
        at += v / total
        name = F.when(u < at, F.lit(k)) if name is None else name.when(u < at, F.lit(k))
    return df.withColumn("split", name.otherwise(F.lit(next(reversed(shares)))))


def arrays(df: DataFrame, features: Sequence[str], label: str = "class_label") -> DataFrame:
    a = df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", F.array(*[F.col(f).cast("double") for f in features]).alias("v"), F.col(label).alias("l")))).alias("a"))
    return a.select(*KEYS, F.transform("a", lambda x: x["v"]).alias("x"), F.transform("a", lambda x: x["l"]).alias("y"))


def padded(df: DataFrame, features: Sequence[str], length: int | None = None, label: str = "class_label") -> DataFrame:
    """One row a track: x, y padded to the longest track, or padded or cut to `length`, and a mask of 1 for real rows."""
    zero = F.array(*[F.lit(0.0)] * len(features))
    a, n = arrays(df, features, label), F.lit(length)
    if length is None:
        a, n = a.join(F.broadcast(longest(df)), F.lit(True)), F.col("longest").cast("int")
    pad = F.greatest(n - F.size("x"), F.lit(0))
    return a.select(*KEYS, F.slice(F.concat("x", F.array_repeat(zero, pad)), F.lit(1), n).alias("x"), F.slice(F.concat("y", F.array_repeat(F.lit(0), pad)), F.lit(1), n).alias("y"), F.slice(F.concat(F.array_repeat(F.lit(1), F.size("x")), F.array_repeat(F.lit(0), pad)), F.lit(1), n).alias("mask"))


def longest(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))


def context_length(df: DataFrame, kind: str = "random") -> DataFrame:
    """The longest usable context: the shortest track, less 9 for random spans."""
    return df.groupBy(*KEYS).agg(F.count("*").alias("n")).agg((F.min("n") - (9 if kind == "random" else 0)).alias("context"))


def spans(df: DataFrame, length: int, count: int | None = None, seed: int = 0) -> DataFrame:
    """cell, mol, start (row from 1): `count` random starts a track without repetition, or all consecutive segments."""
    n = df.groupBy(*KEYS).agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= length)
    if count is None:
        return n.select(*KEYS, F.explode(F.sequence(F.lit(1), F.col("n") - length + 1, F.lit(length))).alias("start"))
    starts = F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda s: F.struct(keyed(seed, *KEYS, s).alias("h"), s.alias("s")))
    return n.select(*KEYS, F.explode(F.slice(F.array_sort(starts), 1, count)).alias("e")).select(*KEYS, F.col("e")["s"].alias("start"))


def windows(df: DataFrame, features: Sequence[str], w: int, label: str | None = None) -> DataFrame:
    """cell, mol, start (row from 1), x: every full window of w consecutive rows, and y with a label."""
    over = track().rowsBetween(0, w - 1)
    out = {"start": F.row_number().over(track()), "x": F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(over)}
    if label:
        out["y"] = F.collect_list(label).over(over)
    return df.withColumns(out).where(F.size("x") == w).select(*KEYS, *out)


def changepoint_mask(df: DataFrame, label: str = "class_label") -> DataFrame:
    return stats.proximal(df, 3, label).withColumn("mask", F.col("proximal").cast("int")).drop("proximal")


def class_weights(df: DataFrame, label: str = "class_label") -> DataFrame:
    """class, weight: inverse frequencies with the number of classes as their sum."""
    n = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")).withColumn("inv", 1 / F.col("n"))
    t = n.agg(F.sum("inv").alias("s"), F.count("*").alias("k"))
    return n.join(F.broadcast(t), F.lit(True)).select("class", (F.col("inv") / F.col("s") * F.col("k")).alias("weight"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, p: str, mask: str, label: str = "class_label") -> DataFrame:
    """loss: mean of -log p of the true class, weighted by class and 1 + 2 * mask; p is floored at 1e-10."""
    w = (1 + 2 * F.col(mask)) * F.col("weight")
    d = df.join(F.broadcast(weights), F.col(label) == F.col("class"))
    return d.agg((F.sum(-F.log(F.greatest(F.col(p), F.lit(1e-10))) * w) / F.sum(w)).alias("loss"))


def _filled(features: Sequence[str]) -> list:
    """Stages that put the features into _x; a missing one (null or NaN) counts as its mean over the training rows."""
    own = [f"_i_{k}" for k in range(len(features))]
    return [Imputer(inputCols=list(features), outputCols=own, strategy="mean"), VectorAssembler(inputCols=own, outputCol="_x", handleInvalid="keep")]


def train_forest(df: DataFrame, features: Sequence[str], label: str = "class_label", trees: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    """A forest on weighted classes. Features without a value in any training row are an error; else missing values are filled (_filled)."""
    weighted = df.join(F.broadcast(class_weights(df, label)), F.col(label) == F.col("class")).withColumn("_label", F.col(label) - 1.0)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="weight", predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_filled(features), forest]).fit(weighted)


def score_forest(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with pred and p, the probability of the prediction: every row, those with missing features as well."""
    scored = model.transform(df).withColumns({"pred": (F.col("_p") + 1).cast("int"), "p": F.array_max(vector_to_array("_prob"))})
    return scored.select(*df.columns, "pred", "p")


def bag(tree: int, seed: int, order: Sequence[str]) -> Column:
    """How often a row is in the bag of a tree, a Poisson number of mean 1 from a hash of tree and row: whoever asks later gets the same."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), *order), 11) / F.lit(2.0**53)
    n, share, most = F.lit(0), math.exp(-1), 0.0
    for k in range(1, 12):
        most += share
        n = n + (u >= F.lit(most)).cast("int")
        share /= k
    return n


def train_bagged(df: DataFrame, features: Sequence[str], label: str = "class_label", trees: int = 20, depth: int = 5, seed: int = 0, order: Sequence[str] = (*KEYS, "frame")) -> tuple[list[PipelineModel], DataFrame]:
    """Trees of a forest, each trained on its own bag() of rows and trying the root of the number of features at a node; and the rows to which they were fitted."""
    rows = written(df.join(F.broadcast(class_weights(df, label)), F.col(label) == F.col("class")).select(*order, *features, label, "weight"))
    models = []
    for t in range(trees):
        own = rows.withColumns({"_b": bag(t, seed, order), "_label": F.col(label) - 1.0}).where("_b > 0").withColumn("_w", F.col("weight") * F.col("_b"))
        tree = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_w", predictionCol=f"_p{t}", probabilityCol="", rawPredictionCol="", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + t)
        models.append(Pipeline(stages=[*_filled(features), tree]).fit(own))
    return models, rows


def out_of_bag_errors(models: Sequence[PipelineModel], rows: DataFrame, label: str, seed: int, order: Sequence[str]) -> list[float | None]:
    """For each tree its share of wrong labels among the rows that its bag left out (None without such rows). One pass over the rows."""
    d = rows
    for t, m in enumerate(models):
        d = m.transform(d).select(*d.columns, f"_p{t}")
    wrong = [F.avg(F.when(bag(t, seed, order) == 0, (F.col(f"_p{t}") + 1 != F.col(label)).cast("double"))).alias(f"e{t}") for t in range(len(models))]
    return list(d.agg(*wrong).first())


def out_of_bag_importance(df: DataFrame, features: Sequence[str], label: str = "class_label", trees: int = 20, depth: int = 5, seed: int = 0, order: Sequence[str] = (*KEYS, "frame")) -> DataFrame:
    """feature, importance, increase, rank: by how much the error of the trees on the rows that they didn't see grows with one feature dealt anew over all rows.

    increase is the mean over trees, importance that mean over its deviation (null if all trees agree). Deterministic: bags and deals are hashes.
    """
    models, rows = train_bagged(df, features, label, trees, depth, seed, order)
    base = out_of_bag_errors(models, rows, label, seed, order)
    found = []
    for k, f in enumerate(features):
        dealt = out_of_bag_errors(models, stats.shuffled(rows, f, seed + k, order), label, seed, order)
        found += [(f, b - a) for a, b in zip(base, dealt, strict=True) if a is not None]
    grown = df.sparkSession.createDataFrame(found, "feature string, more double")  # a row a feature and tree
    return stats.ranked(grown.groupBy("feature").agg(F.try_divide(F.avg("more"), F.stddev_samp("more")).alias("importance"), F.avg("more").alias("increase")), "increase")


def positions(df: DataFrame, features: Sequence[str], w: int, reach: int, label: str | None = None) -> DataFrame:
    """A row for each window and position in it: cell, mol, start, offset, _x, and y with a label: the window laid out around the position.

    _x holds the features of the positions up to `reach` before and after, zeros where these are outside the window.
    """
    zero = F.array(*[F.lit(0.0)] * len(features))
    near = lambda p: F.flatten(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.coalesce(F.get("x", p + k), zero)))
    d = windows(df, features, w, label).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    return d.select(*KEYS, "start", "offset", array_to_vector(near(F.col("offset"))).alias("_x"), *([F.get("y", F.col("offset")).alias("y")] if label else []))


def train_windows(df: DataFrame, features: Sequence[str], w: int, reach: int = 3, stride: int | None = None, label: str = "class_label", trees: int = 10, depth: int = 6, seed: int = 0) -> PipelineModel:
    """A scorer of windows, a forest with one label a position, from every stride-th window of each track (w // 2 if not given). Features shouldn't be null."""
    d = positions(df, features, w, reach, label).where((F.col("start") - 1) % (stride or max(1, w // 2)) == 0)
    d = written(d.join(F.broadcast(class_weights(d, "y")), F.col("y") == F.col("class")).select("_x", (F.col("y") - 1.0).alias("_label"), "weight"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="weight", predictionCol="_p", probabilityCol="_prob", rawPredictionCol="", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[forest]).fit(d)


def score_trained_windows(model: PipelineModel, df: DataFrame, features: Sequence[str], w: int, reach: int = 3) -> DataFrame:
    """Consensus labels of rows (A-09) from a model of train_windows() over all windows of w rows. Probabilities are summed by row before they are shuffled by class."""
    scored = model.transform(positions(df, features, w, reach)).select(*KEYS, (F.col("start") + F.col("offset")).cast("int").alias("row"), vector_to_array("_prob").alias("_v"))
    sums = scored.select(*KEYS, "row", F.posexplode("_v").alias("_c", "_q")).groupBy(*KEYS, "row", (F.col("_c") + 1).alias("class")).agg(F.sum("_q").alias("p"), F.count("*").alias("windows"))
    return annotate.consensus_of_sums(sums)


Scorer = Callable[[pd.Series], list[list[list[float]]]]


def score_windows(df: DataFrame, features: Sequence[str], w: int, scorer: Scorer, classes: int) -> DataFrame:
    """Consensus labels of rows from a scorer of windows: scorer takes a Series of windows and gives, for each, positions by classes of scores.

    Windows reach the scorer in Arrow batches; scores become probabilities by softmax, and each row is labelled by all windows over it.
    """
    wins = windows(df, features, w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            s = np.asarray(scorer(b["x"]), float).reshape(len(b), w, classes)
            e = np.exp(s - s.max(axis=2, keepdims=True))
            prob = e / e.sum(axis=2, keepdims=True)
            # windows of a track follow each other, so their sums by row and class are taken here: a few rows a localisation leave the batch, not w
            which = b.groupby(list(KEYS), sort=False, dropna=False).ngroup().to_numpy()
            first = np.unique(which, return_index=True)[1]
            row = b["start"].to_numpy()[:, None] + np.arange(w)
            keys, at = np.unique(np.stack([np.repeat(which, w), row.ravel()], axis=1), axis=0, return_inverse=True)
            sums, windows_ = np.zeros((len(keys), classes)), np.bincount(at.ravel(), minlength=len(keys))
            np.add.at(sums, at.ravel(), prob.reshape(-1, classes))
            named = {k: np.repeat(b[k].to_numpy()[first][keys[:, 0]], classes) for k in KEYS}
            yield pd.DataFrame({**named, "row": np.repeat(keys[:, 1], classes), "class": np.tile(np.arange(1, classes + 1), len(keys)), "p": sums.ravel(), "windows": np.repeat(windows_, classes)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    scored = wins.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", row int, class int, p double, windows long")
    return annotate.consensus_of_sums(scored)


def score_tracks(df: DataFrame, features: Sequence[str], length: int | None, scorer: Callable[[pd.Series], list[list[int]]]) -> DataFrame:
    """cell, mol, row, label from a scorer of whole tracks, cut or padded to `length`; without one, tracks of like length are padded to the longest of them.

    The tracks of an Arrow batch go to the scorer by classes of length, each twice as long as the one before, so padding at most doubles what they hold,
    however long one of them is. Padded rows are dropped.
    """
    tracks = arrays(df.withColumn("_y", F.lit(0)), features, "_y").select(*KEYS, "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            n = b["x"].map(len).to_numpy()
            like = np.array([int(k - 1).bit_length() for k in n])
            for c in np.unique(like):
                part, own = b[like == c], n[like == c]
                most = length or int(own.max())
                pad = lambda v: [*map(list, v[:most]), *[[0.0] * len(features)] * (most - len(v))]  # noqa: B023, E731
                labels = scorer(part["x"].map(pad))
                yield pd.DataFrame({**{k: part[k].to_numpy() for k in KEYS}, "labels": [list(v[: min(m, most)]) for v, m in zip(labels, own, strict=True)]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    s = tracks.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", labels array<int>")
    return s.select(*KEYS, F.posexplode("labels").alias("i", "label")).select(*KEYS, (F.col("i") + 1).alias("row"), "label")


def cross_validate(df: DataFrame, features: Sequence[str], folds: int = 3, label: str = "class_label", trees: int = 10, seed: int = 0) -> DataFrame:
    """metric, mean, std over folds by track."""
    d = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *KEYS), F.lit(folds)))
    rows = None
    for k in range(folds):
        model = train_forest(d.where(F.col("_fold") != k), features, label, trees, seed=seed)
        test = score_forest(model, d.where(F.col("_fold") == k))
        m = annotate.macro_metrics(test.groupBy(F.col(label).alias("actual"), F.col("pred").alias("predicted")).agg(F.count("*").alias("n")))
        rows = m if rows is None else rows.unionByName(m)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("accuracy", "precision", "recall", "f1")])).alias("e")).select("e.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def metrics(df: DataFrame, truth: str, predicted: str, mask: str | None = None) -> DataFrame:
    d = df if mask is None else df.where(F.col(mask) == 1)
    return annotate.macro_metrics(d.groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n")))


