"""Language identification by hierarchical discrimination.

First the family of a text's language is predicted by one-versus-rest linear scores, then one-versus-one linear support vector
machines tell apart the languages of that family by votes, ties going to the larger summed margin. Features are
hashed byte trigrams of the letters (case folded for ASCII and Latin-1, everything but letters one space), square-rooted
and scaled to unit length, over the whole text.

Fitted on different (id, text) of rows that are not held out, those of smallest hash, at most SAMPLE of each language and TOTAL of all; of more than
LANGUAGES languages the most frequent are learned. So the sample is bounded by TOTAL, however many rows, repeats or languages there are; it is sorted, and
the same table gives the same model. Every text is predicted.

Defined cases: a null text or one without any letter is `und` with score 0; where nothing can be learned every other text is `und` too, as in an empty
table no row is; one learned language is predicted for all; texts of any length count whole; equal texts are predicted alike, and repeated rows each; of
equal votes and margins the first language by name wins. Extra columns are kept, except those of the names of the results, which the results replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_batches
from .folds import held_out, sample_by
from .shingles import chunks

#: Texts of each language that are learned from, and size of the feature table.
SAMPLE, BUCKETS = 500, 1 << 13
#: Texts of all languages together, and languages, that are learned at most.
TOTAL, LANGUAGES = 2048, 512
UNKNOWN = "und"
#: Families of ISO 639-1 codes; a language outside this list is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of the folded texts, and where each text's trigrams start."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    x = _FOLD[data]
    upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    x[1:][upper] += 32
    # every text starts with a space; of several spaces one stays
    first = np.zeros(len(x), dtype=bool)
    first[starts[:-1][starts[:-1] < len(x)]] = True
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | first[1:]
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    x = x[keep].astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    code[1:-1] = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    return h.astype(np.int64), at


def features(texts: pa.Array) -> np.ndarray:
    """A row of BUCKETS float32 for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, j, data, starts in chunks(texts):
        h, at = trigrams(data, starts)
        for k in range(j - i):
            if at[k + 1] - at[k] > 2:
                out[i + k] = np.bincount(h[at[k] + 1 : at[k + 1] - 1], minlength=BUCKETS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighted to the same sum; y is +1 or -1. Accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w.copy(), b
    step = 1.0 / (4.0 + penalty)  # rows have length 1, the bias adds 1, weights sum to 1, the loss has curvature 2
    for t in range(rounds):
        m = (t / (t + 3)) if t else 0.0
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        pw, pb = w, b
        w, b = vw + step * (2 * (x.T @ slack) - penalty * vw), float(vb + step * 2 * slack.sum())
    return w, b


class Model:
    """Family scores one versus rest, then one machine for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        family = [_FAMILY.get(c, c) for c in self.languages]
        self.families = sorted(set(family))
        of = np.array([self.languages.index(c) for c in languages])
        fam = np.array([self.families.index(f) for f in family])
        columns, biases = [], []
        for f in range(len(self.families)) if len(self.families) > 1 else ():
            w, b = svm(x, np.where(fam[of] == f, 1, -1).astype(np.float32))
            columns.append(w)
            biases.append(b)
        self.pairs = [(i, j) for i in range(len(fam)) for j in range(i + 1, len(fam)) if fam[i] == fam[j]]
        for i, j in self.pairs:
            rows = (of == i) | (of == j)
            w, b = svm(x[rows], np.where(of[rows] == i, 1, -1).astype(np.float32))
            columns.append(w)
            biases.append(b)
        self.w = np.stack(columns, axis=1) if columns else np.zeros((BUCKETS, 0), np.float32)
        self.b = np.array(biases)
        self.members = [[i for i in range(len(fam)) if fam[i] == f] for f in range(len(self.families))]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.w + self.b
        nf = len(self.families) if len(self.families) > 1 else 0
        out = []
        for m in margins:
            f, score = 0, 1.0
            if nf:
                f = int(m[:nf].argmax())
                score = _sure(m[f] - max(v for i, v in enumerate(m[:nf]) if i != f))
            best = self.members[f][0]
            if len(self.members[f]) > 1:
                votes = {i: [0, 0.0] for i in self.members[f]}
                for (i, j), v in zip(self.pairs, m[nf:], strict=True):
                    if i in votes:
                        votes[i if v >= 0 else j][0] += 1
                        votes[i][1] += v
                        votes[j][1] -= v
                best = max(votes, key=lambda i: (votes[i][0], votes[i][1], -i))
                score *= min(_sure(2 * v if i == best else -2 * v) for (i, j), v in zip(self.pairs, m[nf:], strict=True) if best in (i, j))
            out.append((self.languages[best], float(score)))
        return out


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-3.0 * margin)))


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """The model from rows of docs (doc_id, text, lang) that are not held out; None where no row has text and language."""
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    learn = learn.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), "text")
    names = [r["lang"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(LANGUAGES, total)).collect()]
    if not names:
        return None
    chosen = learn.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in names], "lang string")), "lang")
    ids = sample_by(chosen, "lang", min(sample, max(1, total // len(names))), "h")
    rows = learn.join(F.broadcast(ids), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = sorted(map_batches(rows, _counted, "lang string, h long, at binary, n binary").collect(), key=lambda r: (r["lang"], r["h"]))
    x = np.zeros((len(few), BUCKETS), np.float32)
    for i, r in enumerate(few):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    return Model(x, [r["lang"] for r in few])


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Buckets and counts of each text."""
    at_of, n_of = [], []
    for _, _, data, starts in chunks(batch.column("text")):
        h, at = trigrams(data, starts)
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = np.bincount(h[a + 1 : b - 1], minlength=BUCKETS) if b - a > 2 else np.zeros(BUCKETS, np.int64)
            k = np.flatnonzero(n)
            at_of.append(k.astype(np.int32).tobytes())
            n_of.append(n[k].astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(at_of, pa.binary()), pa.array(n_of, pa.binary())], names=["lang", "h", "at", "n"])


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    schema = StructType([*[f for f in docs.schema.fields if f.name not in (lang_pred, score)], StructField(lang_pred, StringType()), StructField(score, DoubleType())])
    names = schema.names[:-2]

    def run(batch: pa.RecordBatch) -> pa.Table:
        said: list[tuple[str, float]] = []
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512).column(text)
            found = model.predict(features(part)) if model else [(UNKNOWN, 0.0)] * len(part)
            lettered = _lettered(part)
            said += [f if ok else (UNKNOWN, 0.0) for f, ok in zip(found, lettered, strict=True)]
        return pa.table({**{n: batch.column(n) for n in names}, lang_pred: pa.array([x[0] for x in said], pa.string()), score: pa.array([x[1] for x in said], pa.float64())})

    return map_batches(docs, run, schema)


def _lettered(texts: pa.Array) -> list[bool]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
