"""Runs of words that repeat with a period, found on a grammar of the words.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least LEAST words and TIMES periods long, that no neighbouring
word extends. For each text:

* Words become ids. Stretches that can hold a run are kept by a sieve that loses none: each GRAM words in a run occur again q words on, q being at most a third
  of the stretch.
* Re-Pair turns the ids of a stretch into a grammar: the most frequent pair of neighbours becomes a nonterminal until no pair occurs twice; what remains
  is joined into a balanced tree.
* For each nonterminal, once, the runs across the boundary of its two halves are found from the longest common extensions on both sides of the boundary.
* They are translated to all positions of the nonterminal in the derivation. The lowest nonterminal that holds all of a run gives the whole of it, others parts;
  intervals of one period that overlap by a period are merged.

Work follows the text: a text is one row, nothing is shuffled, and rows of any length are taken whole.

Defined cases: a null or empty text has no words, no runs and the empty text as its collapsed one; repeated rows give their result each; an empty table gives
no rows. Extra columns are kept, except those of the names of the results, which these replace.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Words and periods that a run has at least; words of the sieve's grams: a run then holds at least 2 q grams twice, q words apart.
LEAST, TIMES, GRAM = 24, 3, 8


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside which no run lies, by grams that occur again near by."""
    out, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        part = ids[a:b].astype(np.uint64)
        n = b - a - GRAM + 1
        g = part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        for width in (1, 2, 4):  # a hash of 8 words; equal hashes of different grams keep too much, never too little
            g = (g[:-width] ^ (g[:-width] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + g[width:] * np.uint64(0x94D049BB133111EB)
        order = np.argsort(g, kind="stable")
        near = (g[order[1:]] == g[order[:-1]]) & (order[1:] - order[:-1] <= (b - a) // TIMES)
        again = np.zeros(n + 2, bool)
        again[1 + order[1:][near]] = True
        again[1 + order[:-1][near]] = True
        turns = np.flatnonzero(again[1:] != again[:-1])
        found = [(a + s, a + e + GRAM - 1) for s, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        if found == [(a, b)]:
            out.append((a, b))
        else:
            todo += found
    return sorted(out)


class Grammar:
    """Re-Pair of a sequence: symbol k from `base` on stands for the pair rules[k - base], of sizes[k - base] words; top is what remains."""

    def __init__(self, seq: list[int]):
        n = len(seq)
        self.base = base = max(seq, default=-1) + 1
        self.rules: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        sym = [*seq, -1]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        at: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            at.setdefault((sym[i], sym[i + 1]), []).append(i)
        heap = [(-len(p), k, pair) for k, (pair, p) in enumerate(at.items()) if len(p) > 1]
        heapq.heapify(heap)
        turn = len(at)
        while heap:
            count, _, pair = heapq.heappop(heap)
            a, b = pair
            # where the pair still stands, each word in one occurrence
            live, last = [], -1
            for i in at.pop(pair, ()):
                if sym[i] == a and i != last and (j := nxt[i]) < n and sym[j] == b:
                    live.append(i)
                    last = j if a == b else -1
            if len(live) < 2:
                continue
            if len(live) < -count:
                at[pair] = live
                heapq.heappush(heap, (-len(live), turn, pair))
                turn += 1
                continue
            new = base + len(self.rules)
            self.rules.append(pair)
            self.sizes.append(self.size(a) + self.size(b))
            fresh = {}
            for i in live:
                j = nxt[i]
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k < n:
                    prv[k] = i
                    fresh.setdefault((new, sym[k]), []).append(i)
                if (h := prv[i]) >= 0:
                    fresh.setdefault((sym[h], new), []).append(h)
            for made, places in fresh.items():
                places = sorted(set(places))
                if len(places) > 1:
                    at[made] = places
                    heapq.heappush(heap, (-len(places), turn, made))
                    turn += 1
        self.top = []
        i = 0
        while i < n:
            self.top.append(sym[i])
            i = nxt[i]

    def size(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.sizes[symbol - self.base]

    def nodes(self) -> dict[int, tuple[int, int, list[int]]]:
        """For each nonterminal of at least LEAST words, the rest's balanced tree included: where its halves meet, its size, and all its positions."""
        places: dict[int, list[int]] = {}
        halves: dict[int, tuple[int, int]] = {}
        ends = np.concatenate([[0], np.cumsum([self.size(s) for s in self.top])]).tolist()
        todo: list[tuple[int, int]] = []
        joined = -1
        spans = [(0, len(self.top))]
        while spans:  # the rest: a span of symbols becomes a nonterminal of its own
            a, b = spans.pop()
            if ends[b] - ends[a] < LEAST:
                continue
            if b - a == 1:
                todo.append((self.top[a], ends[a]))
                continue
            mid = (a + b) // 2
            halves[joined], places[joined] = (ends[mid] - ends[a], ends[b] - ends[a]), [ends[a]]
            joined -= 1
            spans += [(a, mid), (mid, b)]
        while todo:
            s, p = todo.pop()
            a, b = self.rules[s - self.base]
            m = self.size(a)
            if s not in places:
                places[s], halves[s] = [], (m, self.sizes[s - self.base])
            places[s].append(p)
            if m >= LEAST:
                todo.append((a, p))
            if self.size(b) >= LEAST:
                todo.append((b, p + m))
        return {s: (*halves[s], places[s]) for s in places}


def extensions(s: list[int]) -> list[int]:
    """For each i, how many symbols from i on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def crossing(w: list[int], c: int) -> dict[tuple[int, int], int]:
    """(start, end): smallest period, of the maximal runs of w that hold words on both sides of place c."""
    n = len(w)
    out: dict[tuple[int, int], int] = {}
    left, right = w[:c], w[c:]
    most = n // TIMES
    back = left[::-1]
    behind = extensions(back)  # by q: equal words q apart, backwards from c
    ahead = extensions(right)  # by q: equal words q apart, from c + q on
    over = extensions([*right, -1, *w[max(0, c - most) :]])  # from c on, against those q earlier
    under = extensions([*back, -1, *w[: c + most][::-1]])  # backwards from c, against those q later
    width, tail = min(c, most), min(n, c + most)
    for q in range(1, most + 1):
        # the q words before the boundary are in the run, or the q words after it
        if q <= c:
            b = behind[q] if q < c else 0
            f = over[len(right) + 1 + width - q]
            if f and q + b + f >= max(LEAST, TIMES * q):
                out.setdefault((c - q - b, c + f), q)
        if q <= n - c:
            f = ahead[q] if q < n - c else 0
            b = under[len(back) + 1 + tail - c - q]
            if b and q + b + f >= max(LEAST, TIMES * q):
                out.setdefault((c - b, c + q + f), q)
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for a, b in stretches(ids):
        seq = ids[a:b].tolist()
        for c, size, places in Grammar(seq).nodes().values():
            here = crossing(seq[places[0] : places[0] + size], c)
            found.update((q, a + p + s, a + p + e) for (s, e), q in here.items() for p in places)
    out: list[tuple[int, int, int]] = []
    for q, s, e in sorted(found):
        if out and out[-1][2] == q and s <= out[-1][1] - q:
            out[-1] = (out[-1][0], max(e, out[-1][1]), q)
        else:
            out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, e, q in runs:
        keep[s + q : e] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])

Words = Callable[[list[bytes], object], list[bytes]]


def periodic_runs(df: DataFrame, text: str = "text", key: str | None = None, words: Words | None = None) -> DataFrame:
    """df with runs, an array of (start, length, period) by start, then period, and collapsed, the text without repeats, in place of `text`.

    words(words, key) may change the words of a text first; key is a column of df.
    """
    import re

    kept = [f for f in df.schema.fields if f.name not in (text, "runs", "collapsed")]
    schema = StructType([*kept, StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    split = re.compile(rb"[^\x20\x09-\x0D]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = part.column(key).to_pylist() if key else [None] * part.num_rows
                runs, texts = [], []
                for value, k in zip(part.column(text), keys, strict=True):
                    raw = value.as_buffer()
                    own = split(raw) if raw is not None else []
                    own = words(own, k) if words else own
                    number: dict[bytes, int] = {}
                    found = runs_of(np.array([number.setdefault(w, len(number)) for w in own], np.int64)) if len(own) >= LEAST else []
                    runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
                    texts.append(b" ".join(without_repeats(own, found)).decode())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(runs, shape), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """Words with a planted run: for one h in ten, those from a place on repeat with a period; both follow from h."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def best(runs: str = "runs") -> "F.Column":
    """The run of greatest length / period, ties to the smallest start, then period; null without runs. Ratios are compared exactly, crosswise."""

    def better(b: "F.Column", r: "F.Column") -> "F.Column":
        return F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
