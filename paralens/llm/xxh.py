"""XXH64 of many byte runs of one buffer, vectorised over runs of equal length."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
LONG = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(words8: np.ndarray, words4: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    left, h = length, None
    if length >= 32:
        with np.errstate(over="ignore"):
            lanes = [np.full(len(at), v, dtype=U64) for v in (U64(seed) + P1 + P2, U64(seed) + P2, U64(seed), U64(seed) - P1)]
        while left >= 32:
            for k in range(4):
                lanes[k] = _round(lanes[k], words8[at + 8 * k])
            at, left = at + 32, left - 32
        h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _round(np.zeros(1, dtype=U64), lane)) * P1 + P4
    else:
        with np.errstate(over="ignore"):
            h = np.full(len(at), U64(seed) + P5, dtype=U64)
    h = h + U64(length)
    while left >= 8:
        h = _rotl(h ^ _round(np.zeros(1, dtype=U64), words8[at]), 27) * P1 + P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _rotl(h ^ (words4[at].astype(U64) * P1), 23) * P2 + P3
        at, left = at + 4, left - 4
    while left:
        h = _rotl(h ^ (data[at].astype(U64) * P5), 11) * P1
        at, left = at + 1, left - 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for each i, as unsigned 64-bit integers."""
    out = np.zeros(len(start), dtype=U64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words8 = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    words4 = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(data) + 1,), (1,))
    length = end - start
    order = np.argsort(length, kind="stable")
    marks = np.flatnonzero(np.diff(length[order], prepend=-1))
    for lo, hi in zip(marks, [*marks[1:], len(order)]):
        rows = order[lo:hi]
        size = int(length[rows[0]])
        if size <= LONG:
            out[rows] = _same_length(words8, words4, data, start[rows], size, seed)
        else:
            for i in rows:
                out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out
