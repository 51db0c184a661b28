"""Word shingles as 64-bit hashes, computed over whole Arrow columns with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, after A-Z became a-z. The shingles of a text are its runs of
`width` words; a text of fewer words has one shingle, the whole sequence; a text without words, or a null, has none.

Two different shingles of a table of n have equal hashes by chance only (n * n / 2**65 pairs to be expected).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words of more bytes are hashed one by one, with a cryptographic hash.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, A-Z as a-z; zeros follow the end."""
    folded = np.zeros(len(data) + 8, dtype=np.uint8)
    folded[: len(data)] = _LOWER[data]
    return np.ndarray((len(data),), "<u8", folded, strides=(1,))


def block(view: np.ndarray, s: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k+8 of the words that start at s and are longer than 8k; bytes behind a word are zero."""
    beyond = np.maximum(0, 8 * (k + 1) - length).astype(np.uint64) * np.uint64(8)
    return view[s + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> beyond)


def _hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word, a block of eight bytes after the other; different words of one length up to 8 never have the same."""
    length = e - s
    view = eights(data)
    h = mix(length.astype(np.uint64) * _C)
    rows = np.flatnonzero(length <= LONG)
    for k in range(LONG // 8):
        rows = rows[length[rows] > 8 * k]
        if not len(rows):
            break
        h[rows] = mix((h[rows] + _B) ^ block(view, s[rows], length[rows], k))
    for i in np.flatnonzero(length > LONG).tolist():
        raw = _LOWER[data[s[i] : e[i]]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, cut: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts data[starts[i]:starts[i+1]]: hashes, starts, ends, and where each text's words start among them.

    cut(data, begins) may mark further places inside words where a new one begins.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    if cut is not None:
        begins |= cut(data, begins) & solid
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n] | begins[1:]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    return _hash(data, s, e), s, e, np.searchsorted(s, starts)


def chunks(texts: pa.Array):
    """(first text, text after the last, bytes, offsets into them) for runs of texts of about CHUNK bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if len(texts) else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _distinct(words: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    total = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        total = total * _C + words[k : k + len(total)]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(total[a : b - width + 1])
            if len(h) > 1:
                keep = np.empty(len(h), dtype=bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                h = h[keep]
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * _C + w
            h = mix(np.array([one], dtype=np.uint64))
        else:
            h = np.empty(0, dtype=np.uint64)
        out.append(h)
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending (uint64)."""
    out: list[np.ndarray] = []
    for _, _, part, starts in chunks(texts):
        words, _, _, at = word_hashes(part, starts)
        out += _distinct(words, at, width)
    return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a shingle set; equal sets have equal ids, the empty set has 0."""
    if len(shingles) == 0:
        return 0
    spread = mix(shingles + _B)
    both = np.array([spread.sum(dtype=np.uint64)]) ^ (np.array([np.bitwise_xor.reduce(spread)]) * _C) ^ np.uint64(len(shingles))
    return int(mix(both).view(np.int64)[0])
