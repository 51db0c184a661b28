"""Token ids of a word-level BPE tokenizer (lower case, white space dropped), for whole columns.

The tokenizer's splitter never joins text across white space, nor letters with digits or with other characters, so each such
run has ids of its own. The distinct runs of a batch are found with numpy by hash, and every run is compared, byte by byte, with the one
that stands for its hash, so ids never depend on chance; only distinct runs are encoded, with a bounded cache that lasts as long as the Python worker. Where these rules could fail, a run up to the next white space is kept whole and
goes through the tokenizer's own pattern: with an apostrophe, or with characters beyond the common Latin letters.
"""

from __future__ import annotations

import array
import unicodedata

import numpy as np
import pyarrow as pa

from .shingles import block, chunks, eights, word_hashes

#: Entries of the cache of runs; the first that come, the frequent ones, stay.
CACHE = 400_000
#: Classes of bytes: 0 white space, 1 letters (with the bytes of U+00C0-U+00FF and U+0140-U+017F), 2 digits, 3 others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:256] = 1
_CLASS[48:58] = 2
_ODD = np.zeros(256, dtype=bool)
_ODD[ord("'")] = True
_ODD[0xC0:] = True
_ODD[[0xC3, 0xC5]] = False


def _cut(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the class changes inside a run up to white space, unless the run has something odd."""
    kind = _CLASS[data]
    new = np.zeros(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    odd = _ODD[data]
    sign = (data[1:] == 0x97) | (data[1:] == 0xB7)  # the multiplication and the division sign are no letters
    odd[1:] |= sign & (data[:-1] == 0xC3)
    at = np.flatnonzero(odd)
    if len(at):
        first = np.flatnonzero(begins)
        run = np.unique(np.searchsorted(first, at, side="right") - 1)
        stop = np.append(first, len(data))[run + 1]
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, first[run], 1)
        np.add.at(inside, stop, -1)
        new &= np.cumsum(inside[:-1]) == 0
    return new


def _lead(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Length and first 16 bytes of each run."""
    out = np.zeros((len(s), 3), np.uint64)
    length = e - s
    out[:, 0] = length
    if len(s):
        view = eights(data)
        out[:, 1] = block(view, s, length, 0)
        longer = np.flatnonzero(length > 8)
        out[longer, 2] = block(view, s[longer], length[longer], 1)
    return out


_loaded: dict[str, WordTokens] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free letter from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.letters = _byte_letters()
        self.runs: dict[bytes, bytes] = {}
        self.plain = set("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")

    @classmethod
    def load(cls, path: str) -> WordTokens:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        return array.array(self.kind, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def run(self, raw: bytes) -> bytes:
        """Ids of one run, in the width of `kind`: as bytes, as the cache holds very many."""
        text = raw.decode()
        if text.isalpha() and max(text) < "ɐ" and "İ" not in text or text in self.plain:
            ids = self._piece(text.lower())
        elif max(text) < "ɐ":
            ids = b"".join([self._piece(x) for x in self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))])
        else:
            ids = array.array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.runs) < CACHE and len(raw) < 64:
            self.runs[raw] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids start (one more entry than texts)."""
        hashes, spans, firsts, leads = [], [], [], []
        known = self.runs.get
        words = 0
        for _, _, part, starts in chunks(texts):
            h, s, e, at = word_hashes(part, starts, _cut)
            hashes.append(h)
            firsts.append(at[:-1] + words)
            spans.append((words, part.tobytes(), s, e))
            leads.append(_lead(part, s, e))
            words += len(h)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        bounds = np.array([x[0] for x in spans] + [words])

        def raw_of(word: int) -> bytes:
            begin, raw, s, e = spans[int(np.searchsorted(bounds, word, side="right")) - 1]
            return raw[s[word - begin] : e[word - begin]]

        ids: list[bytes] = [None] * len(distinct)  # type: ignore[list-item]
        order = np.argsort(first)
        of = first[order]
        place = 0
        for k, (begin, view, s, e) in enumerate(spans):
            stop = int(np.searchsorted(of, bounds[k + 1]))
            for d, a, b in zip(order[place:stop].tolist(), s[of[place:stop] - begin].tolist(), e[of[place:stop] - begin].tolist(), strict=True):
                raw = view[a:b]
                ids[d] = known(raw) or self.run(raw)
            place = stop
        if words:
            lead = np.concatenate(leads)
            stands = first[which]
            differ = (lead != lead[stands]).any(axis=1)
            for w in np.flatnonzero(~differ & (lead[:, 0] > 16) & (stands != np.arange(words))).tolist():
                differ[w] = raw_of(w).lower() != raw_of(int(stands[w])).lower()
            for w in np.flatnonzero(differ).tolist():  # another run has the same hash
                which[w] = len(ids)
                ids.append(self.run(raw_of(w)))
        width = 2 if self.kind == "H" else 4
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        flat = np.frombuffer(b"".join(ids), dtype=f"<u{width}") if ids else np.empty(0, np.uint16)
        begins = np.cumsum(lengths) - lengths
        n = lengths[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(begins[which] - (ends - n), n)
        starts_of = np.concatenate([[0], ends])
        at = np.concatenate([*firsts, [words]]) if firsts else np.zeros(1, np.int64)
        return flat[take], starts_of[at]
