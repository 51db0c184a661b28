"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks (runs of text between block elements). Each block has features of its ancestors (tags,
words of class, id and role names, the innermost sectioning elements) and of its text (leaf tag, length, share of links,
punctuation). The field has two labels, article and other, with one weight for each feature and one for each pair of neighbours; it is
trained by maximum likelihood on labelled pages (forward-backward, gradient steps with weight decay) and decoded by Viterbi.

The text of a page is its article blocks in page order, joined by one space. Character references are decoded; white space in
a block is one space; nothing is cut.

Defined cases: a null or empty html has an empty text; a page that ends inside a tag loses only that tag; unclosed elements end with their parent,
and unclosed scripts, styles, frames, text fields and titles with the page, as in browsers;
a page without article blocks has an empty text; pages of any length count whole; repeated rows are extracted each; an empty table gives no rows. Extra
columns are kept, except one of the name of the result, which the result replaces.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_batches
from .html_blocks import leaf_blocks, names_of, text_names
from .labelled_pages import labelled_pages

TRAIN_PAGES = 1200


class Field:
    """Weights of features for article against other, and of pairs of labels (other, article)."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, start: float):
        self.weights, self.pairs, self.start = weights, pairs, start

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        weigh = lambda name: self.weights.get(name, 0.0)
        blocks = leaf_blocks(page, weigh)
        scores, previous = [], 0
        for text, frame, tag, linked in blocks:
            scores.append(frame.score + sum(map(weigh, text_names(text, tag, linked, previous))))
            previous = text.count(" ") + 1
        return " ".join(b[0] for b, label in zip(blocks, self.decode(scores), strict=True) if label)

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not scores:
            return []
        (oo, oa), (ao, aa) = self.pairs.tolist()
        o, a = 0.0, scores[0] + self.start
        back = []
        for s in scores[1:]:
            back.append((ao + a > oo + o, aa + a > oa + o))
            o, a = max(oo + o, ao + a), max(oa + o, aa + a) + s
        label = int(a > o)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[str, list[tuple[str, bool]]]], rounds: int = 200, decay: float = 1e-5, rate: float = 0.15) -> Field:
    """Maximum likelihood on labelled pages: (html, [(text of a block, is article)])."""
    names: dict[str, int] = {}
    sequences, labels = [], []
    for html, truth in pages:
        left = list(truth)
        rows, marks, previous = [], [], 0
        for block in leaf_blocks(html):
            # blocks are matched to labels in order; one that the labels don't know belongs to the label before
            shown = " ".join(block[0].split())
            at = next((i for i, (t, _) in enumerate(left[:4]) if " ".join(t.replace("&amp;", "&").split()) == shown), None)
            if at is not None:
                last = left[at][1]
                del left[: at + 1]
                marks.append(int(last))
            else:
                marks.append(marks[-1] if marks else 0)
            rows.append([names.setdefault(x, len(names)) for x in names_of(block, previous)])
            previous = block[0].count(" ") + 1
        if rows:
            sequences.append(rows)
            labels.append(marks)
    n, t = len(sequences), max(map(len, sequences))
    y = np.zeros((n, t), np.int64)
    live = np.zeros((n, t), bool)
    at_row, at_name = [], []
    for i, (rows, marks) in enumerate(zip(sequences, labels, strict=True)):
        y[i, : len(marks)], live[i, : len(marks)] = marks, True
        for j, row in enumerate(rows):
            at_row += [i * t + j] * len(row)
            at_name += row
    at_row, at_name = np.array(at_row), np.array(at_name)
    w, pairs, start = np.zeros(len(names)), np.zeros((2, 2)), 0.0
    m1 = [np.zeros_like(w), np.zeros_like(pairs), 0.0]
    m2 = [np.zeros_like(w), np.zeros_like(pairs), 0.0]
    both = live[:, 1:] & live[:, :-1]
    seen_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    total = live.sum()
    for step in range(1, rounds + 1):
        s = np.bincount(at_row, w[at_name], minlength=n * t).reshape(n, t)
        unit = np.stack([np.zeros_like(s), s], axis=2)
        unit[:, 0, 1] += start
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = unit[:, 0]
        for k in range(1, t):
            new = np.logaddexp(forward[:, k - 1, :1] + pairs[0], forward[:, k - 1, 1:] + pairs[1]) + unit[:, k]
            forward[:, k] = np.where(live[:, k, None], new, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = backward[:, k + 1] + unit[:, k + 1]
            new = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
            backward[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        p = np.where(live, np.exp(forward[:, :, 1] + backward[:, :, 1] - z), 0.0)
        gap = np.where(live, y - p, 0.0)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.where(both, np.exp(np.minimum(0, forward[:, :-1, a] + pairs[a, b] + unit[:, 1:, b] + backward[:, 1:, b] - z)), 0).sum()
        gradient = [np.bincount(at_name, gap.ravel()[at_row], minlength=len(w)) / total - decay * w, (seen_pairs - expected) / total - decay * pairs, gap[:, 0].sum() / total - decay * start]
        new = []
        for i, (value, g) in enumerate(zip((w, pairs, start), gradient, strict=True)):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            new.append(value + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8))
        w, pairs, start = new
    return Field({k: float(w[i]) for k, i in names.items()}, pairs, float(start))


@cache
def train(n: int = TRAIN_PAGES, seed: int = 0) -> Field:
    """The field of so many labelled pages; fitted once in a driver process, as the same pages give the same field."""
    return fit(labelled_pages(n, seed))


def extract(pages: DataFrame, field: Field, html: str = "html", out: str = "text") -> DataFrame:
    """pages with `out`, the main text, in place of `html`."""
    schema = StructType([*[f for f in pages.schema.fields if f.name not in (html, out)], StructField(out, StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([field.extract(x.as_py()) for x in batch.column(html)], pa.string())
        return pa.RecordBatch.from_arrays([found if n == out else batch.column(n) for n in schema.names], names=schema.names)

    return map_batches(pages, run, schema)
