"""Encoding over distinct words is the library's, decoding gives the texts back."""

import random
import struct

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackspark.llm import word_table as W

PATH = P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "\n", " \n ", "a", " a", "  a", "   a", "a ", "a  ", "a\n", "a \n b", "a\n b", "a\n\n  b", "a\r\n b", "\t a", "don't we'll 's 'S", "3.5 km/h, \"x\"…", "é É ß 東京 กขค 😀😀 x",
    "a\x1cb \x1c c", "a b   c", "x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "<|endof text|>", "՘ a ꟎1 \U00010940b", "á b", "#" * 5000, "ab" * 40_000, " ".join("w%d" % (i % 700) for i in range(3000)),
]


def texts(n):
    rnd = random.Random(5)
    marks = ["a", "Wort", "don't", "12", "3,4", ".", "\n", " ", "  ", "\t", "é", "東", "<|endoftext|>", "'s", "😀", " ", "՘"]
    return ODD + ["".join(rnd.choice(marks) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", [W.BLOCK, 200])
def test_ids_are_the_librarys(spark, block):
    t = Tokenizer.from_file(PATH)
    rows = [(i, x, f"e{i}") for i, x in enumerate(texts(300))] + [(9000, None, "null"), (9001, "again", "x"), (9001, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Extra string").repartition(3)
    got = W.encode(docs, PATH, block=block)
    assert got.columns == ["doc_id", "Extra", "ids"]
    found = {(r.doc_id, r.Extra): r.ids for r in got.collect()}
    assert len(found) == len(rows) - 1
    for i, x, e in rows:
        assert found[i, e] == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:60]
    packed = {(r.doc_id): bytes(r.ids) for r in W.encode(docs, PATH, packed=True, block=block).collect()}
    assert all(packed[i] == struct.pack(f"<{len(found[i, e])}I", *found[i, e]) for i, x, e in rows)
    for ids in (got, W.encode(docs, PATH, packed=True, block=block)):
        back = W.decode(ids, W.pieces(spark, PATH), out="raw")
        assert {r.doc_id: bytes(r.raw).decode() for r in back.collect()} == {i: x or "" for i, x, _ in rows}
        assert back.count() == len(rows)


def test_decoding_is_a_join(spark):
    t = Tokenizer.from_file(PATH)
    ids = [[], [1, 2, 50256], [50257, 5, 1 << 20], [-1, 7], [None, 7], None]
    got = {r.k: bytes(r.bytes) for r in W.decode(spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>"), W.pieces(spark, PATH)).collect()}
    assert [got[k] for k in range(6)] == [t.decode([i for i in x or [] if i and 0 <= i <= 50256], skip_special_tokens=False).encode() for x in ids]


def test_each_word_is_encoded_once(spark):
    table = W.pa.table({"_block": [1, 2], "_numbers": [W._squeeze(W.np.array([0, 1]), W.np.array([2, 1])), W._squeeze(W.np.array([5]), W.np.array([2]))], "_words": [W_zip(b"abc"), W_zip(b"ab")]})
    out = W._encode_words(PATH, table)
    assert [W._spread(x, 2)[0].tolist() for x in out["_numbers"].to_pylist()] == [[0, 1], [5]]
    a, b = (W._spread(x, 1)[0].tolist() for x in out["_ids"].to_pylist())
    assert a[: len(b)] == b


def W_zip(raw):
    import zstandard

    return zstandard.compress(raw)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.encode(empty, PATH).count() == 0 and W.decode(W.encode(empty, PATH), W.pieces(spark, PATH)).count() == 0
    clash = spark.createDataFrame([(1, "a b", [3], 4)], "_text long, body string, ids array<int>, _block int")
    r = W.encode(clash, PATH, "body").first()
    assert r.asDict() == {"_text": 1, "_block": 4, "ids": Tokenizer.from_file(PATH).encode("a b").ids}


def test_query_over_the_table(spark, sf):
    from trackspark.llm.queries import QUERIES

    t = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_word_table_bpe"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    from hashlib import sha256

    for i, x in docs.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
