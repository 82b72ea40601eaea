"""Hashes of words and of word runs, the same in every process.

A word's hash has two 64-bit halves. Of a word up to 16 bytes they are mixes of
its bytes as two numbers (words up to 8 bytes never meet, as mixing is one to
one), of a longer one the 128-bit xxh3 of its bytes. A run's hash is a tree over
word hashes: the hashes of runs of 2, 4, 8.. words are made level by level, each
a multiply-and-mix of two neighbours, and a run of any length is joined from the
levels of its binary digits. No step is a polynomial, so words or runs in
Thue-Morse order and the like do not meet, and a run costs a few vector
operations whatever its length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
PIECE, SHORT = 1 << 16, 16
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_STEP = {1: U(0xD1342543DE82EF95), 2: U(0xC6A4A7935BD1E995)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _numbers(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[i] <= 8 bytes from at[i] on, as a number; ``raw`` has 16 spare bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)[at]
    return np.ascontiguousarray(eight).view("<u8").ravel() & _MASK[n]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each word raw[start[i]:end[i]]; ``raw`` has 16 spare bytes."""
    n = end - start
    low = _numbers(raw, start, np.minimum(n, 8))
    high = _numbers(raw, np.minimum(start + 8, len(raw) - 8), np.clip(n - 8, 0, 8))
    size = np.minimum(n, SHORT + 1).astype(U)
    one = mix(mix(low + U(0x9E3779B97F4A7C15)) + high * U(0xD6E8FEB86659FD93) + size)
    two = mix(mix(low ^ U(0xA0761D6478BD642F)) ^ mix(high + size * U(0xE7037ED1A0B428DB)))
    for i in np.flatnonzero(n > SHORT):
        value = xxhash.xxh3_128_intdigest(raw[start[i] : end[i]].tobytes())
        one[i], two[i] = value & 0xFFFFFFFFFFFFFFFF, value >> 64
    return one, two


class Words:
    """Words of consecutive texts: ``hash`` and ``hash2`` (the two halves), byte
    ``start`` and ``end``, ``off`` (words of text i are off[i]:off[i + 1]) and, if
    asked for, ``shas``: the SHA-256 of each text's words joined by one space.
    Words are taken in pieces of ``PIECE``, so a long text needs little more."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, shas: bool = False):
        n = len(raw)
        solid = ~_BLANK[raw]
        first, last = solid.copy(), solid.copy()
        if n:
            edges = offsets[(offsets > 0) & (offsets < n)]
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            first[edges] = solid[edges]
            last[edges - 1] = solid[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, offsets)
        spare = np.concatenate([raw, np.zeros(16, np.uint8)])
        parts = [word_hashes(spare, self.start[a : a + PIECE], self.end[a : a + PIECE]) for a in range(0, len(self.start), PIECE)]
        self.hash, self.hash2 = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, U) for k in (0, 1))
        self.shas = [self._sha(raw, int(a), int(b)) for a, b in zip(self.off, self.off[1:])] if shas else []

    def _sha(self, raw: np.ndarray, a: int, b: int) -> bytes:
        sha = hashlib.sha256()
        for p in range(a, b, PIECE):
            words = raw[self.start[p] : self.end[min(p + PIECE, b) - 1]].tobytes().split()
            sha.update((b" " if p > a else b"") + b" ".join(words))
        return sha.digest()

    def __len__(self) -> int:
        return len(self.hash)


def runs(words: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of each run of ``k`` words; empty if there are fewer."""
    n = len(words)
    if n < k or k < 1:
        return np.empty(0, U)
    step, level, width = _STEP[which], mix(words + U(which)), 1
    out, done = None, 0
    while True:
        if k & width:
            # joined from the left: the digits so far, then this level's run
            out = level if out is None else mix(out[: n - done - width + 1] * step + level[done : n - width + 1] + U(done))
            done += width
        if done == k:
            return out[: n - k + 1]
        level = mix(level[: n - 2 * width + 1] * step + level[width : n - width + 1])
        width *= 2


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive values, in two passes over blocks."""
    n = len(x)
    if w == 1:
        return x.copy()
    pad = -n % w
    fill = x[-1:] if n else x
    blocks = np.concatenate([x, np.repeat(fill, pad)]).reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def winnow(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the least of some valid window of ``w`` grams;
    valid[i] tells whether window i counts. Every valid window holds one."""
    if len(grams) < w:
        return np.empty(0, np.int64)
    least = np.where(valid, slide(grams, w, np.minimum), U(0))
    edge = np.zeros(w - 1, U)
    most = slide(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero((most == grams) & (most > 0))
