"""Runs on a grammar are those of the definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.llm import periodic_runs as R
from trackspark.llm.queries import QUERIES


def plain(w):
    """Every period in turn, by the definition."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q) and not any(all(w[k] == w[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                out.append((s, i + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def cases(n):
    rnd = random.Random(3)
    for t in range(n):
        m = rnd.randint(0, 160)
        w = []
        while len(w) < m:
            u = [rnd.randrange(rnd.choice([1, 2, 5, 50])) for _ in range(rnd.randint(1, 30))]
            w += (u * rnd.randint(1, 8))[: rnd.randint(1, 120)]
        if t % 3 == 0 and m > 30:
            w[rnd.randrange(len(w))] = 99
        yield w
    yield [1] * 500
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b


def test_runs_are_those_of_the_definition():
    seen = 0
    for w in cases(400):
        got = R.runs_of(np.array(w, np.int64))
        assert got == plain(w)
        seen += len(got)
    assert seen > 300


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 6)), max_size=6))
def test_random_powers(parts):
    w = [x for u, k in parts for x in u * k]
    assert R.runs_of(np.array(w, np.int64)) == plain(w)


def test_grammar_derives_its_sequence():
    for w in cases(60):
        g = R.Grammar(w)

        def words(s, g=g):
            return [s] if s < g.base else words(g.rules[s - g.base][0]) + words(g.rules[s - g.base][1])

        assert [x for s in g.top for x in words(s)] == w
        pairs = list(zip(g.top, g.top[1:]))
        assert all(pairs.count(p) == 1 or p[0] == p[1] for p in pairs)
        for s, (_, size, places) in g.nodes().items():
            if s >= 0:
                assert size == len(words(s)) and all(w[p : p + size] == words(s) for p in places)


def test_the_sieve_loses_no_run():
    for w in cases(200):
        kept = R.stretches(np.array(w, np.int64))
        assert all(any(a <= s and e <= b for a, b in kept) for s, e, _ in plain(w))


def answer(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = plain([number[w] for w in words])
    top = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    return (doc_id, len(runs), *own, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {answer(r.doc_id, r.text) for r in docs if len(r.text or "") < 12_000}
    got = QUERIES["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    found = {tuple(r) for r in got.collect()}
    assert want <= found and len(found) == len(docs) and sum(r[1] > 0 for r in found) > 10


def test_odd_rows(spark):
    long = " ".join(["x y"] * 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "é " * 40), (4, "é " * 40), (5, "a b c"), (6, long), (7, "\x1c  " * 30), (8, "k " * 23), (None, "z " * 24)]
    df = spark.createDataFrame([(i, t, i, "keep") for i, t in rows], "doc_id long, text string, collapsed long, Note string")
    got = R.periodic_runs(df)
    assert got.columns == ["doc_id", "Note", "runs", "collapsed"]
    found = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in got.collect()}
    assert found == {(1, ""): [], (2, ""): [], (3, ""): [], (4, "é"): [(0, 40, 1)], (5, "a b c"): [], (6, "x y"): [(0, 60_000, 2)], (7, "\x1c"): [(0, 30, 1)], (8, ("k " * 23).strip()): [], (None, "z"): [(0, 24, 1)]}
    assert got.count() == 10 and R.periodic_runs(df.limit(0)).count() == 0


def test_best_run_is_compared_exactly(spark):
    big = 3_000_000_000
    runs = [[(9, 30, 10), (2, 60, 20), (1, 29, 10)], [], [(0, big, big // 3), (5, big + 1, big // 3)], [(4, 30, 10), (4, 24, 8)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "k int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r.k: r.b and tuple(r.b) for r in df.select("k", R.best().alias("b")).collect()}
    assert got == {0: (9, 30, 10), 1: None, 2: (5, big + 1, big // 3), 3: (4, 30, 10)}
    assert df.where(F.size("runs") < 0).select(R.best()).count() == 0
