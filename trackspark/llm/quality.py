"""Quality scores by Bradley-Terry pairwise ranking.

Every document has a strength w.x, linear in features of its whole text; that a good document is preferred to a bad one has
probability sigmoid(w.(x_good - x_bad)). The weights minimise the logistic loss over pairs of differences. Features are a handful of shares
(kinds of characters, words and lines that repeat) and the words and byte trigrams themselves, hashed into buckets; what the buckets weigh is learned
together with the shares, under a stronger penalty, as there are many of them. The threshold is a
quantile of the strengths of all labelled documents that are not held out, at the share of bad ones among them (the widest gap near it); the score is a
sigmoid that takes the value CUT at this threshold.

The weights are fitted on at most SAMPLE documents of each label (smallest hash of the id) that are not held out; their ids are bounded and
may be broadcast, and only their feature rows come to the driver. Share and quantile are exact, over all that are not held out: Spark ranks their strengths,
and a row a partition comes to the driver. Every document is scored.

Defined cases: a null text counts as empty, and empty texts have features of zeros; null labels or ids are not learned from; of an id with two labels
the better counts, and of an id with several texts the first by order is learned from; with labels of
one kind only, or none, every score is the share of good labels (0.5 without any); texts of any length count whole; equal texts have equal scores, and those
whose strength is the threshold pass; repeated rows are scored each; an empty table gives no rows. Extra columns are kept, except one of the name of the
score, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_batches, written
from .folds import held_out, sample_by
from .language import trigrams
from .shingles import _distinct, chunks, word_hashes

SAMPLE, PAIRS, CUT, NEAR = 2500, 100_000, 0.3, 0.008
#: Buckets of words and of byte trigrams each, and the penalties of shares and of buckets.
BUCKETS, PENALTIES = 512, (1e-3, 0.001)
FEATURES = ["upper", "symbols", "bars", "exclamation", "digits", "stops", "adjacent", "repeated", "repeated_lines", "word_length", "long_words"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text: shares of kinds of bytes, and of words and shingles that repeat."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j, data, starts in chunks(texts):
        def count(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])

        upper = _UPPER[data]
        accent = np.zeros(len(data), bool)
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        n = np.maximum(1, np.diff(starts))
        letters = np.maximum(1, count(_LETTER[data]))
        h, s, e, at = word_hashes(data, starts)
        words = np.diff(at)
        w = np.maximum(1, words)
        same = np.zeros(len(h) + 1, np.int64)
        if len(h) > 1:
            same[2:] = np.cumsum(h[1:] == h[:-1])
        inner = np.maximum(at[1:], at[:-1] + 1)
        adjacent = same[np.minimum(inner, len(h))] - same[np.minimum(at[:-1] + 1, len(h))]
        lengths = np.concatenate([[0], np.cumsum(e - s)])
        long = np.concatenate([[0], np.cumsum((e - s) > 20)])
        shingles = np.array([len(x) for x in _distinct(h, at, 5)])
        total = np.maximum(1, words - 4)
        part = out[i:j]
        part[:, 0] = (count(upper) + count(accent)) / letters
        part[:, 1] = count(_SYMBOL[data]) / n
        part[:, 2] = count(data == ord("|")) / w
        part[:, 3] = count(data == ord("!")) / n
        part[:, 4] = count((data >= 48) & (data < 58)) / n
        part[:, 5] = np.minimum(0.25, count((data == ord(".")) | (data == ord(","))) / w)
        part[:, 6] = np.maximum(0, adjacent) / w
        part[:, 7] = np.where(words > 4, 1 - shingles / total, 0)
        part[:, 8] = _repeated_lines(data, starts)
        part[:, 9] = np.minimum(20, np.diff(lengths[at]) / w) / 10
        part[:, 10] = np.diff(long[at]) / w
        part[np.diff(starts) == 0] = 0
    return out


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text a row of BUCKETS for its words and one for the trigrams of its letters: square roots of counts, each of unit length."""
    words, letters = np.zeros((len(texts), BUCKETS), np.float32), np.zeros((len(texts), BUCKETS), np.float32)
    for i, j, data, starts in chunks(texts):
        h, _, _, at = word_hashes(data, starts)
        w = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        g, of = trigrams(data, starts)
        g = g % BUCKETS
        for k in range(j - i):
            words[i + k] = np.bincount(w[at[k] : at[k + 1]], minlength=BUCKETS)
            if of[k + 1] - of[k] > 2:
                letters[i + k] = np.bincount(g[of[k] + 1 : of[k + 1] - 1], minlength=BUCKETS)
    for x in (words, letters):
        np.sqrt(x, out=x)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    return words, letters


def all_features(texts: pa.Array) -> np.ndarray:
    """Shares, buckets of words, buckets of trigrams."""
    return np.hstack([features(texts).astype(np.float32), *hashed(texts)])


def _repeated_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    out = np.zeros(len(starts) - 1)
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            out[k] = 1 - len(set(lines)) / len(lines)
    return out


def near_ranks(bad: int, total: int) -> tuple[int, int]:
    """The first and last number of documents below the threshold."""
    return max(1, int(bad - NEAR * total)), min(total - 1, int(bad + NEAR * total) + 1)


class Model:
    """Means and scales of the shares, weights, and the threshold of strengths; without weights a constant score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalties: tuple[float, float] = PENALTIES, rounds: int = 80, seed: int = 0):
        self.constant = float(y.mean()) if len(y) else 0.5
        self.w = None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        k = len(FEATURES)
        shares = x[:, :k].astype(np.float64)
        self.mean, self.scale = shares.mean(axis=0), np.maximum(shares.std(axis=0), 1e-6)
        z, many = self._scaled(shares), x[:, k:]
        rng = np.random.default_rng(seed)
        i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
        d = z[i] - z[j]
        w, v, push = np.zeros(k), np.zeros(many.shape[1]), np.zeros(many.shape[1])
        seen = np.zeros(pairs)  # what the buckets add to each difference
        for t in range(rounds):
            # Newton steps of the few shares, at first and now and then; between them steps with momentum of the many buckets
            for _ in range(20 if t == 0 else 1 if t % 10 == 0 else 0):
                p = 1 / (1 + np.exp(np.clip(d @ w + seen, -30, 30)))
                gradient = d.T @ p / pairs - penalties[0] * w
                curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalties[0] * np.eye(k)
                change = np.linalg.solve(curvature, gradient)
                w += change
                if np.abs(change).max() < 1e-6:
                    break
            p = 1 / (1 + np.exp(np.clip(d @ w + seen, -30, 30)))
            pull = ((np.bincount(i, p, len(y)) - np.bincount(j, p, len(y))) / pairs).astype(np.float32)
            push = 0.9 * push + (pull @ many - penalties[1] * v) / (1 + penalties[1])  # rows have length 2 at most, the loss curvature 1/4
            v += push
            strength = many @ v.astype(np.float32)
            seen = strength[i] - strength[j]
        self.w, self.v = w, v
        strength = np.sort(self.strength(x))
        # The quantile is good to within NEAR of the ranks; the threshold is the widest gap there.
        first, last = near_ranks(len(bad), len(y))
        ranks = np.arange(first, last + 1)
        at = ranks[np.argmax(strength[ranks] - strength[ranks - 1])]
        self.threshold = float((strength[at - 1] + strength[at]) / 2)

    def _scaled(self, shares: np.ndarray) -> np.ndarray:
        return np.clip((shares - self.mean) / self.scale, -20, 20)

    def strength(self, x: np.ndarray) -> np.ndarray:
        k = len(FEATURES)
        return self._scaled(x[:, :k]) @ self.w + (x[:, k:].astype(np.float64) * self.v).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.constant)
        strength = self.strength(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from docs (doc_id, text) with labels (doc_id, quality) that are not held out."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = sample_by(known.withColumn("_h", F.xxhash64("doc_id")), "quality", sample, "_h")
    few = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_h")).join(F.broadcast(ids), "_h").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def row(b: pa.RecordBatch) -> pa.RecordBatch:
        x = all_features(b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    # the rows arrive in any order
    rows = sorted((r["quality"], bytes(r["x"])) for r in map_batches(few.select("quality", "text"), row, "quality int, x binary").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), len(FEATURES) + 2 * BUCKETS)
    model = Model(x, np.array([r[0] for r in rows]))
    if model.w is not None:
        model.threshold = threshold(docs, known, model)
    return model


def threshold(docs: DataFrame, known: DataFrame, model: Model) -> float:
    """The middle of the widest gap near the quantile of the strengths of all docs with a label in known (doc_id, quality)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _in_parts(batch.column("text"), model.strength).round(9)  # alike in batches of any size
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "s"])

    strengths = map_batches(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text"), run, f"doc_id {kind}, s double")
    each = strengths.join(known, "doc_id").groupBy("doc_id").agg(F.min("s").alias("s"), F.min("quality").alias("quality"))
    values = each.groupBy("s").agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).alias("bad"))
    placed = written(values.sort("s").withColumn("p", F.spark_partition_id()))
    parts = placed.groupBy("p").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("s").alias("low")).orderBy("p").collect()
    first, last = near_ranks(sum(r["bad"] for r in parts), sum(r["n"] for r in parts))
    starts, before = [], 0
    for r, after in zip(parts, [*parts[1:], None], strict=True):
        starts.append((r["p"], before, after and after["low"]))
        before += r["n"]
    w = Window.partitionBy("p").orderBy("s")
    ranked = placed.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "p int, o long, after double")), "p")
    ranked = ranked.select("s", (F.col("o") + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("rank"), F.coalesce(F.lead("s").over(w), "after").alias("next"))
    best = ranked.agg(
        F.max(F.when(F.col("rank").between(first, last), F.struct(F.col("next") - F.col("s"), -F.col("s"), "next"))).alias("gap"),
        F.min(F.when(F.col("rank") >= first, F.col("s"))).alias("same"),  # where all of them are equal
    ).first()
    return float((best["gap"]["next"] - best["gap"][1]) / 2) if best["gap"] and best["gap"]["next"] is not None else float(best["same"])


def _in_parts(texts: pa.Array, of: Callable[[np.ndarray], np.ndarray], rows: int = 512) -> np.ndarray:
    return np.concatenate([np.empty(0), *[of(all_features(texts.slice(a, rows))) for a in range(0, len(texts), rows)]])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score."""
    schema = StructType([*[f for f in docs.schema.fields if f.name != out], StructField(out, DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.Table:
        found = _in_parts(batch.column(text), model.score)
        return pa.table({**{n: batch.column(n) for n in schema.names[:-1]}, out: pa.array(found)})

    return map_batches(docs, run, schema)
