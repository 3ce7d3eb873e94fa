"""Vectorised word spans and hashes over Arrow text batches.

Everything here works on whole Arrow string buffers: one pass finds the words of
all texts of a batch, one pass hashes them, so no Python object is made per word.
Words are runs outside ``\\x20`` and ``\\x09-\\x0D``; only A-Z are lower-cased.
A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: bytes that are hashed at once
PIECE = 1 << 18


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=U64)
        steps[0] = 1
        have = _POWERS[kind] = np.cumprod(steps, dtype=U64)
    return have[:n]


def is_space(data: np.ndarray) -> np.ndarray:
    """Marks the bytes \\x20 and \\x09-\\x0D."""
    return ((data - np.uint8(9)) < 5) | (data == 32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def unmix(h: np.ndarray) -> np.ndarray:
    """What mix() made h of."""
    h = (h ^ (h >> U64(33))) * U64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h = (h ^ (h >> U64(33))) * U64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return h ^ (h >> U64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 offsets of the texts."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Returns free memory to the machine: workers live on after their tasks, and other stages' after theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """The words of a batch of texts: byte spans, owners and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~is_space(data)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data) + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[:-1], after[-1] = inside[1:], False
            after[edge[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        #: word index of the first word of each text, and the total at the end
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), dtype=U64)
        done = 0
        while done < len(self):
            # pieces of bounded size (one word at least), so that a long text needs little memory
            base = self.start[done]
            upto = max(done + 1, int(np.searchsorted(self.end, base + PIECE, side="right")))
            piece = self.data[base : self.end[upto - 1]]
            n = len(piece)
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((piece.astype(U64) + U64(0x51)) * _powers("up", _BASE, n), out=sums[1:])
            start = self.start[done:upto] - base
            out[done:upto] = mix((sums[self.end[done:upto] - base] - sums[start]) * _powers("down", _INVERSE, n + 1)[start])
            done = upto
        return out

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts with one space between words: bytes, and each word's start and end there."""
        keep = np.zeros(len(self.data) + 1, dtype=bool)
        keep[:-1] = ~is_space(self.data)
        follows = np.zeros(len(self.data) + 1, dtype=bool)
        follows[self.end] = True
        follows[self.offsets] = False
        data = np.append(self.data, np.uint8(0x20))
        data[follows] = 0x20
        keep |= follows
        place = np.cumsum(keep)
        return data[keep], place[self.start] - 1, place[self.end - 1]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """utf8() with A-Z lower-cased."""
    data, offsets = utf8(column)
    return data + (((data - np.uint8(0x41)) < 26).view(np.uint8) << np.uint8(5)), offsets


def words_of(column: pa.Array) -> Words:
    return Words(*lowered(column))


def grams(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words within one text."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    last = len(hashes) - n + 1
    out = np.zeros(last, dtype=U64)
    for k in range(n):
        out = (out ^ (out >> U64(29))) * U64(0xBF58476D1CE4E5B9) + hashes[k : k + last]
    at = np.flatnonzero(words.owner[:last] == words.owner[n - 1 :])
    return mix(out[at]), at


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in pieces of about ``most`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done = 0
        while done < batch.num_rows:
            base = sizes[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(done, upto - done)
            done = upto
    give_back()


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """utf8() in lower case (Unicode), with ASCII punctuation turned into spaces."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    data, offsets = utf8(pc.utf8_lower(column))
    mark = ((data - np.uint8(0x21)) < 15) | ((data - np.uint8(0x3A)) < 7) | ((data - np.uint8(0x5B)) < 6) | ((data - np.uint8(0x7B)) < 4)
    return np.where(mark, np.uint8(0x20), data), offsets


def folded_words(column: pa.Array) -> Words:
    return Words(*folded(column))
