"""Token ids of a lower-casing word-level BPE, with a memo of chunks between ASCII blanks.

The vocabulary never joins text across white space, and its normaliser lower-cases, so a text's ids are
those of its blank-separated chunks in turn, after A-Z became a-z. Chunks repeat; their ids are kept as
little-endian 32-bit bytes. Chunks that the memo lacks are merged many at a time in numpy where they are
plain words (Latin letters, then ASCII marks); the tokenizer library takes all others.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Chunks kept by a Python worker, and the longest that is kept; about 150 bytes each.
MEMO, MEMO_BYTES = 600_000, 40
_LOADED: dict[str, "WordBpe"] = {}
_WORD = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")
_NONE = 1 << 30


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Lowest-rank-first pair merging of many words at once, a row per word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        symbols = _byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.bits = 21
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        for rank, (k, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[at] not in (-1, k):
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = k, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where there is no merge. A negative id is no symbol."""
        keys = left << 16 | right
        out = np.full(keys.shape, _NONE, np.int64)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys, flat = keys.ravel()[todo], out.ravel()
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            flat[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != -1)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each (non-empty) word."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[bytes] = [b""] * len(words)
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            for i, ids in zip(part, self._rows([words[i] for i in part])):
                out[i] = ids
        return out

    def _rows(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        x = np.full((len(words), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < lengths[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        x[inside] = self.first[raw]
        x[np.arange(len(words)), lengths - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        result, rows = x.copy(), np.arange(len(words))
        r = self.rank(x[:, :-1], x[:, 1:])
        columns = np.arange(width + 1)
        while len(rows):
            at = r.argmin(1)
            best = r[np.arange(len(rows)), at]
            going = best < _NONE
            if not going.all():
                result[rows[~going]] = x[~going]
                x, r, rows, at, best = x[going], r[going], rows[going], at[going], best[going]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            x[here, at] = self.made[best]
            take = np.minimum(columns + (columns > at[:, None]), width)
            x = np.take_along_axis(x, take, 1)
            x[:, -1] = -1
            r = np.take_along_axis(r, np.minimum(take[:, :-1], width - 1), 1)
            r[:, -1] = _NONE
            r[here, at] = self.rank(x[here, at], x[here, np.minimum(at + 1, width)])
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self.rank(x[left, at[left] - 1], x[left, at[left]])
        kept = result >= 0
        flat = result[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a control string inside a text is plain text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.memo: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """The worker's own copy."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, marks: bytes) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {b"": b""}
            self.tails[marks] = self._ids([marks.decode()])[0]
        return self.tails[marks]

    @staticmethod
    def _plain(stem: bytes) -> bytes | None:
        """The stem as the normaliser gives it, if it is of Latin letters alone."""
        if stem.isascii():
            return stem
        s = stem.decode()
        if max(s) >= "ɐ" or "İ" in s or not s.isalpha():
            return None
        s = s.lower()
        return s.encode() if unicodedata.is_normalized("NFC", s) else None

    def _learn(self, missing: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the memo lacks. Letters and the marks after them are always separate tokens."""
        memo, found = self.memo, {}
        split, words, others = [], {}, []
        for c in missing:
            m = _WORD.fullmatch(c) if len(c) <= 4 * MEMO_BYTES else None
            stem = m and self._plain(m[1])
            if not stem:
                others.append(c)
            elif stem in memo:
                found[c] = memo[stem] + self._tail(m[2])
            else:
                words[stem] = None
                split.append((c, stem, m[2]))
        if words:
            for stem, ids in zip(words, self.merges.ids(list(words))):
                words[stem] = ids
            if len(memo) + len(words) <= MEMO:
                memo.update((s, v) for s, v in words.items() if len(s) <= MEMO_BYTES)
            for c, stem, marks in split:
                found[c] = words[stem] + self._tail(marks)
        if others:
            found.update(zip(others, self._ids([c.decode() for c in others])))
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; null is empty."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        get = self.memo.get
        chunks = [(t or "").encode().lower().split() for t in texts]
        ids = [list(map(get, c)) for c in chunks]
        gaps = [[i for i, v in enumerate(x) if v is None] if None in x else () for x in ids]
        missing = {c[i] for c, g in zip(chunks, gaps) for i in g}
        found = self._learn(missing)
        for c, x, g in zip(chunks, ids, gaps):
            for i in g:
                x[i] = found[c[i]]
        self.memo.update((c, v) for c, v in found.items() if len(c) <= MEMO_BYTES)
        return [b"".join(x) for x in ids]
