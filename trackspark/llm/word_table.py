"""BPE encoding and decoding over a table of distinct words.

Texts are split into words where the tokenizer's own pre-tokenizer splits them. Documents are taken in blocks of some millions of characters; a block
keeps its documents as word numbers and sends each of its distinct words once to a bucket, chosen by a hash of the word. A bucket so holds the
part of the table of distinct words with its hashes: each word in it is encoded once, however many blocks asked for it, and its ids go
back to those blocks. There they are joined by number with every position of the documents. Blocks and buckets are plain group keys in Spark: no key
holds more than one row for each block or bucket, so frequent words are no hot keys, and the table is never in one place.

Decoding joins ids with the table of pieces by id. That table has a row for each entry of the vocabulary, a bound that is checked, so it is broadcast.

Defined cases: a null text is the empty text, which has no ids; a null id column and null entries of it decode to nothing, as do ids outside the vocabulary;
repeated rows are encoded each; a text of any length is encoded whole, and one longer than a block is a block of its own; the strings of special tokens
in a text become these tokens, as the library does by default; an empty table gives no rows. Extra columns are kept, except one of the name
of the result, which the result replaces; columns that differ by case only are an error of Spark's.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import free_name, map_batches, shared_dir

#: Characters of a block, characters for each bucket of the table, and the largest vocabulary whose pieces are broadcast.
BLOCK, PER_BUCKET, MOST_PIECES = 8_000_000, 8_000_000, 1 << 21
#: Words whose ids are put in at once.
TOGETHER = 200_000
#: The splitting pattern of byte-level BPE, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes don't depend on the version of Unicode; a text with others is split by the tokenizer itself.
SETTLED = r"[^\x00-՗֐-ࢇऀ-౛ഀ-₎₠-ꟍ가-￿\U0001f000-\U0001faff\U00020000-\U0002b739]"

_loaded: dict[str, Splitter] = {}


class Splitter:
    """Words of texts, as the tokenizer of a file splits them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, special = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens must stand for their own characters only")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in special]
        longest = sorted(self.special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.find, self.unsettled = regex.compile(PATTERN).findall, regex.compile(SETTLED).search

    @classmethod
    def load(cls, path: str) -> Splitter:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def words(self, text: str) -> list[str]:
        if self.apart and any(s in text for s in self.special):
            parts = self.apart.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class _Block:
    """Word numbers of a block's texts.

    A text is cut at its spaces first. A piece behind a space splits alike wherever it stands, unless white space on both of its sides runs together, so
    pieces are split once a block and looked up after that; texts in which white space runs together are split whole.
    """

    def __init__(self, splitter: Splitter):
        self.splitter = splitter
        self.numbers: dict[str, int] = {}  # words
        self.first: dict[str, int] = {}  # pieces at the start of a text, behind a space, and whole words
        self.behind: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.flat: list[int] = []
        self.ends: list[int] = [0]
        self.opens: set[int] = set()  # pieces that start with white space, and that end with it
        self.closes: set[int] = set()

    def _piece(self, words: list[str], text: str) -> int:
        put, n = self.numbers.setdefault, self.numbers
        self.flat += [put(w, len(n)) for w in words]
        self.ends.append(len(self.flat))
        k = len(self.ends) - 2
        if text[:1].isspace():
            self.opens.add(k)
        if text[-1:].isspace():
            self.closes.add(k)
        return k

    def pieces(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        if not any(x in text for x in self.splitter.special):
            cut = text.split(" ")
            known = list(map(self.behind.get, cut))
            known[0] = self.first.get(cut[0])
            if None in known:
                for i, c in enumerate(cut):
                    if known[i] is None:
                        at = self.behind if i else self.first
                        known[i] = at.get(c)
                        if known[i] is None:
                            known[i] = at[c] = self._piece(self.splitter.words(" " + c if i else c), (c or " ") if i else c)
            if self.closes.isdisjoint(known) or not any(a in self.closes and b in self.opens for a, b in zip(known, known[1:], strict=False)):
                return np.array(known, np.int64)
        found = []
        for w in self.splitter.words(text):
            k = self.whole.get(w)
            if k is None:
                k = self.whole[w] = self._piece([w], w)
            found.append(k)
        return np.array(found, np.int64)

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of pieces, and how many each piece has."""
        ends = np.array(self.ends, np.int32)
        n = np.diff(ends)[at]
        take = _ranges(ends[:-1][at], n)
        return np.array(self.flat, np.int32)[take], n


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n of them, for each entry."""
    stop = np.cumsum(n)
    out = np.repeat((start - (stop - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^24, byte by byte apart, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(np.asarray(a, "<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes() for a in arrays]
    return zstandard.compress(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *planes]), 3)


def _spread(raw: bytes, count: int) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(raw)
    sizes = np.frombuffer(data, "<i8", count)
    out, at = [], 8 * count
    for n in sizes.tolist():
        plane = [np.frombuffer(data, np.uint8, n, at + k * n) for k in range(3)]
        value = plane[2].astype(np.int32)
        for k in (1, 0):
            value <<= 8
            value |= plane[k]
        out.append(value)
        at += 3 * n
    return out


def _split(splitter: Splitter, part: pa.RecordBatch, text: str, block: int, buckets: int) -> Iterator[tuple]:
    """Rows (block, bucket, rows, numbers, words) of one block: its documents with bucket -1, and a row for each bucket that it asks."""
    import zstandard

    own = _Block(splitter)
    pieces = [own.pieces(t.as_py() or "").astype(np.int32) for t in part.column(text)]
    ends = np.cumsum(np.array([len(p) for p in pieces]))
    word, each = own.expand(np.concatenate(pieces))
    del pieces
    before = np.concatenate([[0], np.cumsum(each)])
    lengths = np.diff(before[np.concatenate([[0], ends])])
    # frequent words get small numbers, which take few bits
    order = np.argsort(-np.bincount(word, minlength=len(own.numbers)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    if len(order) >= 1 << 24:
        raise ValueError("a text with more than 2^24 different words")
    kept = pa.Table.from_batches([part]).drop_columns([text])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(kept)
    yield block, -1, sink.getvalue().to_pybytes(), _squeeze(rank[word]), np.asarray(lengths, "<i8").tobytes()
    names = np.array(list(own.numbers), dtype=object)[order]
    if not len(names):
        return
    of = (pd.util.hash_array(names, categorize=False) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[by])) + 1
    for at in np.split(by, cuts):
        raw = [w.encode() for w in names[at].tolist()]
        yield block, int(of[at[0]]), None, _squeeze(np.diff(at, prepend=0), np.array([min(len(r), (1 << 24) - 1) for r in raw])), zstandard.compress(b"".join(raw), 3)


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """The same rows, read back from a table in the shared folder that is bucketed by a column. Only while it is read is it known to the catalog, which keeps how it is bucketed."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = f"trackspark_{path[-32:]}"
    df.write.bucketBy(buckets, by).option("compression", "zstd").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return table


_SPLIT = StructType([StructField("_block", LongType()), StructField("_bucket", IntegerType()), StructField("_rows", BinaryType()), StructField("_numbers", BinaryType()), StructField("_words", BinaryType())])
_IDS = "_block long, _numbers binary, _ids binary"


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", packed: bool = False, block: int = BLOCK) -> DataFrame:
    """df with `out`, the ids of `text`, in place of `text`: array<int>, or packed as little-endian unsigned 32-bit integers in a binary.

    The split is made once and written to the shared folder, bucketed by block. Two exchanges follow, words to their buckets and ids back to their blocks; documents stay where they are.
    """
    spark = df.sparkSession
    used = free_name(df, "_text")
    named = df.withColumnRenamed(text, used).drop(out)
    size = named.agg(F.sum(F.char_length(used))).first()[0] or 0
    buckets = max(16, -(-size // PER_BUCKET))
    names = _SPLIT.names

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, at = Splitter.load(path), 0
        for batch in batches:
            sizes = np.cumsum(pa.compute.utf8_length(batch.column(used)).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + block, side="right")))
                for row in _split(splitter, batch.slice(start, stop - start), used, TaskContext.get().partitionId() << 32 | at, buckets):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=_SPLIT_ARROW)
                start, at = stop, at + 1

    rows = _bucketed(named.mapInArrow(split, _SPLIT), "_block", buckets)
    asked = rows.where("_bucket >= 0").select("_block", "_bucket", "_numbers", "_words").groupBy("_bucket").applyInArrow(lambda t: _encode_words(path, t), _IDS)
    kinds = StructType([f for f in named.schema.fields if f.name != used] + [StructField(out, BinaryType() if packed else ArrayType(IntegerType()))])
    docs = rows.where("_bucket < 0").select("_block", "_rows", "_numbers", F.col("_words").alias("_lengths"))
    return docs.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(lambda a, b: _fill(a, b, kinds.names, packed), kinds)


_SPLIT_ARROW = pa.schema([("_block", pa.int64()), ("_bucket", pa.int32()), ("_rows", pa.binary()), ("_numbers", pa.binary()), ("_words", pa.binary())])


def _encode_words(path: str, asked: pa.Table) -> pa.Table:
    """A bucket: all its distinct words encoded once, and the ids of each block's words."""
    import zstandard

    known: dict[bytes, int] = {}
    rows = []
    for block, numbers, words in zip(asked["_block"].to_pylist(), asked["_numbers"], asked["_words"], strict=True):
        rank, length = _spread(numbers.as_py(), 2)  # numbers as steps from one to the next
        raw = zstandard.decompress(words.as_py())
        if len(length) and length.max() == (1 << 24) - 1:  # words so long that their length didn't fit
            length[length.argmax()] += len(raw) - length.sum()
        ends = np.cumsum(length).tolist()
        rows.append((block, rank, [known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)]))
    tokenizer = Splitter.load(path).tokenizer
    ids: list[np.ndarray] = []
    listed = list(known)
    for at in range(0, len(listed), 20_000):
        ids += [np.array(e.ids, np.int64) for e in tokenizer.encode_batch([w.decode() for w in listed[at : at + 20_000]], add_special_tokens=False)]
    out = [(block, _squeeze(rank, np.array([len(ids[k]) for k in which])), _squeeze(np.concatenate([ids[k] for k in which]))) for block, rank, which in rows]
    return pa.table({"_block": pa.array([r[0] for r in out], pa.int64()), "_numbers": pa.array([r[1] for r in out], pa.binary()), "_ids": pa.array([r[2] for r in out], pa.binary())})


def _fill(docs: pa.Table, ids: pa.Table, names: list[str], packed: bool) -> pa.Table:
    """A block: the ids of its words are put at every position of its documents."""
    got = [(*_spread(n.as_py(), 2), _spread(i.as_py(), 1)[0]) for n, i in zip(ids["_numbers"], ids["_ids"], strict=True)]
    words = sum(len(g[0]) for g in got)
    count, start = np.zeros(words, np.int32), np.zeros(words, np.int32)
    flat = np.concatenate([g[2] for g in got]).astype(np.uint32) if got else np.empty(0, np.uint32)
    before = 0
    for step, n, own in got:
        rank = np.cumsum(step)
        count[rank] = n
        start[rank] = before + np.cumsum(n) - n
        before += len(own)
    del got
    parts = []
    for rows, numbers, lengths in zip(docs["_rows"], docs["_numbers"], docs["_lengths"], strict=True):
        kept = pa.ipc.open_stream(rows.as_py()).read_all()
        (at,) = _spread(numbers.as_py(), 1)
        n = count[at]
        stop = np.cumsum(n, dtype=np.int64)
        filled = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        for k in range(0, len(at), TOGETHER):
            part = slice(k, k + TOGETHER)
            end = int(stop[min(k + TOGETHER, len(at)) - 1])
            filled[int(stop[k] - n[k]) : end] = flat[_ranges(start[at[part]], n[part])]
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_py(), "<i8"))])]
        column = _binary(filled, ends) if packed else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(filled.astype(np.int32)))
        parts.append(pa.table({c: column if c == names[-1] else kept[c] for c in names}))
    return pa.concat_tables(parts)


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers, one value for each stretch between ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype("<i8").tobytes()), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece (bytes): the table of pieces of a tokenizer's vocabulary with its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the printable stand-in of each byte: itself if printable, else the next free letter from U+0100
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    rows = [(i, bytearray(byte_of[c] for c in w) if all(c in byte_of for c in w) else bytearray(w.encode())) for w, i in vocabulary.items()]
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(rows)} pieces is too large to broadcast")
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(df: DataFrame, table: DataFrame, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with `out`, the bytes of the pieces that `ids` (array<int>, or packed) stand for, in place of `ids`; table is that of pieces()."""
    held = table.where("id >= 0 AND piece IS NOT NULL").dropDuplicates(["id"]).orderBy("id").toArrow()  # a row for each entry of the vocabulary
    if held.num_rows > MOST_PIECES:
        raise ValueError(f"a table of {held.num_rows} pieces is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), held["piece"].to_pylist()))
    schema = StructType([f for f in df.schema.fields if f.name not in (ids, out)] + [StructField(out, BinaryType())])
    is_packed = isinstance(df.schema[ids].dataType, BinaryType)

    def run(batch: pa.RecordBatch) -> pa.Table:
        known, piece = shared.value
        values = pa.array([*piece, b""], pa.large_binary())  # the last stands for ids that aren't in the table
        parts = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            column = part.column(ids)
            if is_packed:
                flat = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), "<u4").astype(np.int64)
                n = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) // 4
            else:
                flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            hit = np.searchsorted(known, flat)
            hit = np.where((hit < len(known)) & (np.append(known, -1)[np.minimum(hit, len(known))] == flat), hit, len(known))
            joined = values.take(pa.array(hit))
            offsets = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1, joined.offset * 8) if len(joined) else np.zeros(1, np.int64)
            ends = offsets[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
            data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype("<i8").tobytes()), data]).cast(pa.binary())
            parts.append(pa.table({c: column if c == out else part.column(c) for c in schema.names}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.binary()) if c == out else batch.column(c) for c in schema.names})

    return map_batches(df, run, schema)
