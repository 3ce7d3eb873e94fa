"""Static range asymmetric numeral system over integer ids, vectorised across lanes.

A segment holds one frequency table shared by its blocks.  A block codes ``lanes``
interleaved streams of ``steps`` symbols each with states of its own; its entry
keeps the lane states, the number of words and two checksums, so each block is a
checkpoint from which decoding can start without the others.

Layout (little-endian): header ``<4sBBHIQIII`` (magic, version, scale bits, lanes,
steps, symbols, blocks, table bytes, table crc32), the table (zlib of two uint32
columns: ids, frequencies), then for each block ``<III`` (symbols, words, crc32 of
states and words), uint64 states, uint32 words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"rANS", 1
HEADER = struct.Struct("<4sBBHIQIII")
BLOCK = struct.Struct("<III")
LOW = np.uint64(1 << 31)
U64 = np.uint64


def symbols_of(ids: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, ascending, the place of each id among them, and their counts; memory doesn't grow with the ids' size."""
    if len(ids) and ids.max() < most:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        row = np.zeros(len(counts), dtype=np.int64)
        row[symbols] = np.arange(len(symbols))
        return symbols.astype(np.uint32), row[ids], counts[symbols]
    symbols, rows, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return symbols.astype(np.uint32), rows.astype(np.int64), counts


def table_of(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of the symbols (at least 1, total 2**bits) and the bits."""
    bits = min(24, max(12, int(4 * max(1, len(symbols)) - 1).bit_length()))
    if len(symbols) > 1 << bits:
        raise ValueError("too many different ids for one table")
    freq = 1 + counts.astype(object if counts.sum() > 1 << 38 else np.int64) * ((1 << bits) - len(symbols)) // max(1, int(counts.sum()))
    freq = freq.astype(np.int64)
    if len(freq):
        freq[np.argmax(counts)] += (1 << bits) - freq.sum()
    return freq.astype(np.uint32), bits


def _encode(sym: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sym: (blocks, steps, lanes) table rows.  States after coding, words, words of each block."""
    blocks, steps, lanes = sym.shape
    state = np.full((blocks, lanes), LOW, dtype=U64)
    words = np.empty((blocks, steps, lanes), dtype=np.uint32)
    put = np.empty((blocks, steps, lanes), dtype=bool)
    limit = (LOW >> U64(bits)) << U64(32)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        f = freq[s]
        full = state >= limit * f
        words[:, t], put[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> U64(32), state)
        q = state // f
        state = (q << U64(bits)) + (state - q * f) + start[s]
    return state, words[put], put.reshape(blocks, -1).sum(axis=1)


def _decode(state: np.ndarray, words: np.ndarray, begin: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    blocks, lanes = state.shape
    out = np.empty((blocks, steps, lanes), dtype=np.int64)
    at, mask = begin.astype(np.int64).copy(), U64((1 << bits) - 1)
    for t in range(steps):
        slot = state & mask
        s = slots[slot]
        out[:, t] = s
        state = freq[s] * (state >> U64(bits)) + slot - start[s]
        need = state < LOW
        place = np.cumsum(need, axis=1)
        state[need] = (state[need] << U64(32)) | words[(at[:, None] + place - 1)[need]]
        at += place[:, -1]
    return out


def encode(ids: np.ndarray, lanes: int = 32, steps: int = 512) -> bytes:
    """One segment of the ids (unsigned, below 2**32); no ids give a segment without blocks."""
    ids = np.asarray(ids)
    symbols, rows, counts = symbols_of(ids)
    freq, bits = table_of(symbols, counts)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    size = lanes * steps
    whole = len(ids) // size
    out = [b""]
    f64 = freq.astype(U64)
    begin = np.concatenate([[0], np.cumsum(f64)[:-1]]).astype(U64) if len(f64) else f64
    parts = [(rows[: whole * size].reshape(whole, steps, lanes), [size] * whole)] if whole else []
    if rest := len(ids) - whole * size:
        left = -(-rest // lanes)
        padded = np.full(left * lanes, int(np.argmax(freq)))
        padded[:rest] = rows[whole * size :]
        parts.append((padded.reshape(1, left, lanes), [rest]))
    for sym, sizes in parts:
        state, words, used = _encode(sym, f64, begin, bits)
        ends = np.cumsum(used)
        for k, n in enumerate(sizes):
            body = state[k].astype("<u8").tobytes() + words[ends[k] - used[k] : ends[k]].astype("<u4").tobytes()
            out += [BLOCK.pack(n, int(used[k]), zlib.crc32(body)), body]
    out[0] = HEADER.pack(MAGIC, VERSION, bits, lanes, steps, len(ids), sum(len(c) for _, c in parts), len(table), zlib.crc32(table)) + table
    return b"".join(out)


def decode(data: bytes, first: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of a segment, or of ``blocks`` of its blocks from ``first`` on; checks every checksum it passes."""
    magic, version, bits, lanes, steps, total, n, size, crc = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    table = data[HEADER.size : HEADER.size + size]
    if zlib.crc32(table) != crc:
        raise ValueError("the table's checksum differs")
    columns = np.frombuffer(zlib.decompress(table), dtype="<u4")
    symbols, freq = columns[: len(columns) // 2], columns[len(columns) // 2 :].astype(U64)
    begin = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(U64) if len(freq) else freq
    slots = np.repeat(np.arange(len(freq)), freq.astype(np.int64))
    at, entries = HEADER.size + size, []
    for _ in range(n):
        count, words, crc = BLOCK.unpack_from(data, at)
        entries.append((count, words, crc, at + BLOCK.size))
        at += BLOCK.size + 8 * lanes + 4 * words
    entries = entries[first : None if blocks is None else first + blocks]
    out = []
    for lo in range(0, len(entries), 256):
        some = entries[lo : lo + 256]
        groups = [[e for e in some if e[0] == lanes * steps], *[[e] for e in some if e[0] != lanes * steps]]
        for group in filter(None, groups):
            for count, words, crc, place in group:
                if zlib.crc32(data[place : place + 8 * lanes + 4 * words]) != crc:
                    raise ValueError("a block's checksum differs")
            state = np.stack([np.frombuffer(data, "<u8", lanes, e[3]) for e in group]).astype(U64)
            words = np.concatenate([np.frombuffer(data, "<u4", e[1], e[3] + 8 * lanes) for e in group]).astype(U64)
            used = np.cumsum([0, *(e[1] for e in group[:-1])])
            rows = _decode(state, words, used, -(-group[0][0] // lanes), freq, begin, slots, bits)
            for k, e in enumerate(group):
                out.append(symbols[rows[k].ravel()[: e[0]]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
