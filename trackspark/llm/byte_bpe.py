"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text of any length is halved until its parts have at most LEAF characters, ten to twenty words; parts are encoded alone; neighbours are joined up the tree. A join re-encodes a
window around the seam that grows on either side until what lies outside is proven to stay:

* at a place where no match of the splitting pattern can reach across (text up to white space, a run of letters up to
  something else, a run of digits up to something else), because matches are encoded apart and the pattern looks no further
  than the character after a match;
* inside one long match (a run of one class without such a place), at tokens t, u that encode to themselves when joined:
  a sequence all of whose neighbours have this property is the encoding of its bytes.

Decoding concatenates the bytes of the tokens up a tree of halves. Ids equal those of encoding the whole text at once.

Defined cases: a null text is encoded as the empty text, which has no ids; a null id array, and null entries of one, decode to no bytes; ids
outside the vocabulary raise an error; very long texts and runs without any safe place are joined like others; repeated rows are encoded each; an
empty table gives no rows. Extra columns are kept, except one of the name of the result, which the result replaces.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import map_batches

#: Characters of a leaf, ids of a leaf, and the first width of a window.
LEAF, LEAF_IDS, WINDOW = 128, 64, 64
#: Width of a window from which the inside of a single match is tried.
INSIDE = 512

_loaded: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.bytes = {i: len(b) for b, i in ranks.items()}
        self.safe = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._encode(text, 0, len(text), leaf)

    def _encode(self, text: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self.encoding.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._encode(text, a, mid, leaf), self._encode(text, mid, b, leaf))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._window(text, a, mid, b)
        if start is None or end is None:
            width = WINDOW
            while True:
                lo, hi = max(a, mid - width), min(b, mid + width)
                # a safe place needs the character on either side of it, and must not be the seam itself
                starts = [m.start() for m in self.safe.finditer(text, lo, mid) if lo < m.start() < mid]
                ends = next((m.start() for m in self.safe.finditer(text, mid, hi) if mid < m.start() < hi), None)
                if (starts or lo == a) and (ends is not None or hi == b):
                    break
                if width >= INSIDE and (found := self._inside(left, right, text, lo, mid, hi)) is not None:
                    return found
                width *= 2
            start, end = starts[-1] if starts else a, b if ends is None else ends
        keep, n = len(left), _size(text[start:mid])
        while n > 0:
            keep -= 1
            n -= self.bytes[left[keep]]
        skip, m = 0, _size(text[mid:end])
        while m > 0:
            m -= self.bytes[right[skip]]
            skip += 1
        if n < 0 or m < 0:
            raise AssertionError("a safe place lies inside a token")
        return left[:keep] + self.encoding.encode_ordinary(text[start:end]) + right[skip:]

    def _window(self, text: str, a: int, mid: int, b: int) -> tuple[int | None, int | None]:
        """The nearest safe places within WINDOW before a space, which most texts have; the bounds of the parts where they are as near; else None."""
        lo, hi = max(a, mid - WINDOW), min(b, mid + WINDOW)
        start = text.rfind(" ", lo + 1, mid)
        while start > lo and text[start - 1].isspace():
            start = text.rfind(" ", lo + 1, start)
        end = text.find(" ", mid + 1, hi)
        while end >= 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1, hi)
        return start if start > lo else a if lo == a else None, end if end >= 0 else b if hi == b else None

    def _inside(self, left: list[int], right: list[int], text: str, lo: int, mid: int, hi: int) -> list[int] | None:
        """The join within one match of letters that covers the whole window, or None if it isn't such a match."""
        part = text[lo:hi]
        if not part.isalpha() or (m := self.pattern.fullmatch(part)) is None or m.end() != len(part):
            return None
        limit = min(len(left), len(right))
        left_bytes, right_bytes = len(text[lo:mid].encode()), len(text[mid:hi].encode())
        k = 8
        while k < limit:
            a, b = left[-k:], right[:k]
            raw_a, raw_b = b"".join(map(self.tokens.__getitem__, a)), b"".join(map(self.tokens.__getitem__, b))
            if len(raw_a) + 32 > left_bytes or len(raw_b) + 32 > right_bytes:
                return None  # would leave the part that is known to be one match
            new = self._piece(raw_a + raw_b)
            if self._stays(left[-k - 1], new[0]) and self._stays(new[-1], right[k]):
                return left[:-k] + new + right[k:]
            k *= 2
        return None

    def _piece(self, raw: bytes) -> list[int]:
        return self.encoding._encode_single_piece(raw)

    def _stays(self, t: int, u: int) -> bool:
        return self._piece(self.tokens[t] + self.tokens[u]) == [t, u]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.tokens[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _size(part: str) -> int:
    return len(part) if part.isascii() else len(part.encode())


def _others(df: DataFrame, drop: list[str], new: StructField) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in (*drop, new.name)] + [new])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", leaf: int = LEAF) -> DataFrame:
    """df with `out`, the ids of `text` as array<int>, in place of `text`."""
    schema = _others(df, [text], StructField(out, ArrayType(IntegerType())))
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.Table:
        bpe = ByteBpe.load(path, pattern)
        parts = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [bpe.encode(t or "", leaf) for t in part.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            parts.append(pa.table({n: ids if n == out else part.column(n) for n in names}))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], pa.list_(pa.int32())) if n == out else batch.column(n) for n in names})

    return map_batches(df, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with `out`, the bytes that `ids` stand for, in place of `ids`."""
    schema = _others(df, [ids], StructField(out, BinaryType()))
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = ByteBpe.load(path, pattern)
        raw: list[bytes] = []
        for at in range(0, batch.num_rows, 500):
            lists = batch.column(ids).slice(at, 500)
            flat = lists.flatten()
            known = flat.fill_null(-1).to_numpy().tolist()
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                part = known[e - n : e]
                raw.append(bpe.decode([i for i in part if i >= 0] if flat.null_count else part))
        return pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if n == out else batch.column(n) for n in names], names=names)

    return map_batches(df, run, schema)
