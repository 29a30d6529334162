"""Byte-pair merges of many words at once, from a tokenizer's own vocabulary and merges.

Only for plain words: lower-case a-z and Latin-1 letters, which the tokenizer's normaliser
leaves alone and its splitter keeps whole. The pair of least rank, leftmost first, is merged in
every word in each step, as the library does word by word; `check` holds both together.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)
_BITS, _K = 18, np.uint32(2654435769)


def _letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.keys, self.ranks = np.zeros(1 << _BITS, np.uint32), np.full(1 << _BITS, _NONE)
        for rank, k in enumerate(keys.tolist()):
            at = (k * int(_K) & 0xFFFFFFFF) >> (32 - _BITS)
            while self.ranks[at] != _NONE:
                at = (at + 1) & ((1 << _BITS) - 1)
            self.keys[at], self.ranks[at] = k, rank
        letters = _letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = (k * _K >> np.uint32(32 - _BITS)).astype(np.int64)
        out = self.ranks[at]
        off = np.nonzero((self.keys[at] != k) & (out != _NONE))
        while len(off[0]):
            at[off] = (at[off] + 1) & ((1 << _BITS) - 1)
            out[off] = self.ranks[at[off]]
            off = tuple(x[(self.keys[at[off]] != k[off]) & (out[off] != _NONE)] for x in off)
        return out

    def encode(self, words: list[bytes], rows: int = 4096) -> list[bytes]:
        """The ids of each word, as bytes of int32."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), rows):
            mine = order[a : a + rows]
            self._some([words[i] for i in mine], np.array(mine), out)
        return out

    def _some(self, words: list[bytes], names: np.ndarray, out: list[bytes]) -> None:
        n = np.array([len(w) for w in words])
        wide = int(n[-1])
        s = self.inner[np.frombuffer(b"".join(w.ljust(wide, b" ") for w in words), np.uint8).reshape(-1, wide)]
        i = np.arange(len(n))
        s[i, n - 1] = self.last[np.array([w[-1] for w in words])]
        r = np.full((len(n), wide), _NONE)
        if wide > 1:
            r[:, :-1] = np.where(np.arange(wide - 1) < n[:, None] - 1, self.rank(s[:, :-1], s[:, 1:]), _NONE)
        while len(n):
            j = r.argmin(1)
            least = r[np.arange(len(n)), j]
            done = least == _NONE
            if done.any():
                raw = s[done].tobytes()
                for row, (name, k) in enumerate(zip(names[done].tolist(), n[done].tolist(), strict=True)):
                    out[name] = raw[row * wide * 4 : (row * wide + k) * 4]
                go = ~done
                s, r, n, names, j, least = s[go], r[go], n[go], names[go], j[go], least[go]
                if not len(n):
                    return
            i = np.arange(len(n))
            s[i, j] = self.to[least]
            later = np.arange(wide - 1) > j[:, None]
            s[:, :-1] = np.where(later, s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(later, r[:, 1:], r[:, :-1])
            n -= 1
            new = s[i, j]
            has = j < n - 1
            r[i, j] = _NONE
            r[i[has], j[has]] = self.rank(new[has], s[i[has], j[has] + 1])
            has = j > 0
            r[i[has], j[has] - 1] = self.rank(s[i[has], j[has] - 1], new[has])

    def check(self, encode, words: list[bytes]) -> bool:
        return self.encode(words) == encode(words)
