"""Packing against a round-robin that deals one turn at a time, and token ids where words share a hash."""

import collections
import time
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from trackspark.llm import packing, word_tokens  # noqa: E402
from trackspark.llm.word_tokens import WordTokens  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string"


def dealt(lengths, weights, quantum):
    """(queue, tokens) of each turn as a round-robin with deficits deals them: next is the queue that is first owed its share of a turn more."""
    names = sorted(lengths, key=lambda s: (s is not None, s or ""))
    phase = {s: (zlib.crc32((s or "").encode()) + 0.5) / 2**32 for s in names}
    left, out = dict(lengths), []
    while any(left.values()):
        live = [s for s in names if left[s]]
        s = min(live, key=lambda s: ((lengths[s] - left[s] + phase[s] * min(quantum, left[s])) / weights[s], names.index(s)))
        out.append((s, min(quantum, left[s])))
        left[s] -= out[-1][1]
    return out


def checked(pieces, tokens, window):
    """Pieces by window, after checks that ids are whole, offsets gapless and windows full."""
    by, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for w, found in by.items():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == window or w == max(by)
    assert sorted(by) == list(range(len(by)))
    whole = {r.doc_id: bytes(r.ids) for r in tokens.collect()}
    if len(whole) == tokens.count():
        for i, found in docs.items():
            assert b"".join(bytes(r.ids) for r in sorted(found, key=lambda r: r.start)) == whole[i] and {r.doc_tokens for r in found} == {len(whole[i]) // 4}
    return by


def rows_of(n):
    """Documents of several sources, a null one included, of 0 to 300 words, and some rows twice."""
    rows = [(i, "word " * (i * 7 % 23 if i % 11 else 300), f"s{i * i % 3}" if i % 13 else None) for i in range(n)]
    return [*rows, (n, None, "rare"), (n + 1, "alone", "s9")]


@pytest.mark.parametrize(("window", "quantum", "weights"), [(32, 1, None), (32, 7, None), (64, 256, None), (100, 16, {"s0": 5.0, "s1": 1.0, "s2": 0.5, None: 3.0, "rare": 9.0, "s9": 0.01}), (4096, 256, None)])
def test_windows_are_those_of_a_round_robin(spark, window, quantum, weights):
    tokens = packing.tokenize(spark.createDataFrame(rows_of(90), DOCS).repartition(3), WORD)
    lengths = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    order = [s for s, n in dealt(lengths, weights or lengths, quantum) for _ in range(n)]
    by = checked(packing.pack(tokens, window, weights, quantum).collect(), tokens, window)
    for w, found in by.items():
        got = collections.Counter()
        for r in found:
            got[r.source] += r.length
        assert got == collections.Counter(order[window * w : window * (w + 1)])
        stands = [r.source for r in sorted(found, key=lambda r: r.offset)]
        assert sum(x != y for x, y in zip(stands, stands[1:], strict=False)) == len(set(stands)) - 1  # a source stands together


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    rows = [(None, "no id", None), (3, "word", "s1"), (3, "word", "s1"), (None, "no id", None)]
    tokens = packing.tokenize(spark.createDataFrame(rows, DOCS).repartition(2), WORD)
    got = collections.Counter()
    for r in packing.pack(tokens, 4, quantum=2).collect():
        got[r.doc_id] += r.length
    assert got == collections.Counter({r.doc_id: r.n for r in tokens.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()})


def test_deficits_stay_within_a_quantum(spark):
    rows = [(i, "word " * 40, "large" if i % 8 else f"s{i % 3}") for i in range(1200)]
    tokens = packing.tokenize(spark.createDataFrame(rows, DOCS).repartition(5), WORD)
    lengths = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    given = collections.Counter()
    by = checked(packing.pack(tokens, 1024, quantum=64).collect(), tokens, 1024)
    for w in sorted(by):
        for r in by[w]:
            given[r.source] += r.length
        total = sum(given.values())
        assert all(abs(given[s] - total * n / sum(lengths.values())) <= 2 * 64 for s, n in lengths.items())


def test_ten_thousand_sources_neither_shred_documents_nor_take_long(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of a document "), F.expr("int(20 + id % 61)")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.expr("id % 10007"))).alias("source"))
    tokens = packing.tokenize(docs.repartition(8), WORD)
    begin = time.monotonic()
    pieces = packing.pack(tokens)
    n, length, windows, most = pieces.agg(F.count("*"), F.sum("length"), F.countDistinct("sequence_id"), F.max("sequence_id")).first()
    assert time.monotonic() - begin < 60
    total = tokens.agg(F.sum("n")).first()[0]
    assert length == total and windows == most + 1 == -(-total // 4096)
    assert n < 3 * 20_000
    hot = pieces.where("source = 'hot'").groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"sequence_id < {windows - 1}")
    share = tokens.where("source = 'hot'").agg(F.sum("n")).first()[0] / total
    assert hot.where(F.abs(F.col("n") - 4096 * share) > 2 * packing.QUANTUM).count() <= windows // 10 and hot.count() == windows - 1


def test_large_batches_give_every_document_once(spark):
    docs = spark.range(5003).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("number"), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")).coalesce(1)
    tokens = packing.tokenize(docs, WORD)
    assert tokens.count() == tokens.select("doc_id").distinct().count() == 5003
    pieces = packing.pack(tokens, 64).agg(F.sum("length"), F.countDistinct("doc_id"), F.max("sequence_id")).first()
    total = tokens.agg(F.sum("n")).first()[0]
    assert tuple(pieces) == (total, 5003, (total - 1) // 64)


def test_memory_of_tokenizing_does_not_grow_with_the_length_of_rows(spark, monkeypatch):
    """What a worker holds at once is bounded by bytes of text, not by a number of rows, whatever their length."""
    docs = types.SimpleNamespace(select=lambda *_: docs, mapInArrow=lambda run, _: run)
    monkeypatch.setattr(packing, "written", lambda run: run)
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    run = packing.tokenize(docs, WORD)
    texts = [None, "", *[f"row {i} " + "some words of a document " * 600 for i in range(800)], "one long text " * 300_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["s"] * len(texts))], names=["doc_id", "text", "source"])
    count = [len(x.column("ids")[0].as_py()) // 4 for x in run(iter([batch.slice(k, 1) for k in (0, 1, 2, 802, 803)]))]
    rows, tracked = [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch.slice(0, 802)])):
            rows += zip(*(out.column(c).to_pylist() for c in ("doc_id", "row", "before", "n")), strict=True)
        tracked = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tracked < 120e6  # twelve million bytes of text
    before = 0
    for k, (doc_id, row, at, n) in enumerate(rows):
        assert (doc_id, row, at) == (k, k, before)
        before += n
    assert len(rows) == 802 and [r[3] for r in rows[:3]] == count[:3] and count[3] == 900_001


def test_extra_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "a b", "s", 5, 6, 7)], DOCS + ", n int, queue int, part int")
    assert [r.length for r in packing.pack(packing.tokenize(d, WORD)).collect()] == [3]
    with pytest.raises(ValueError, match="no weight"):
        packing.pack(packing.tokenize(d, WORD), weights={"t": 1.0})


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    words = WordTokens.load(WORD)
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [f"{a} {b}", "one two Two THREE", "a" * 17 + " " + "a" * 16 + "b", None, ""]
    want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]

    def check():
        flat, at = words.encode(pa.array(texts))
        assert [flat[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == want

    check()
    strong = word_tokens.word_hashes
    monkeypatch.setattr(word_tokens, "word_hashes", lambda *x: (strong(*x)[0] % np.uint64(3), *strong(*x)[1:]))
    check()
