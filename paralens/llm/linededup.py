"""Line deduplication by an exact set-similarity join.

A line is the set of its words (lower-cased, without ASCII punctuation).  Two lines
match if the Jaccard similarity of their sets reaches the threshold.  A line is
removed if a line before it, in the order of (id, line number), matches it.

1. Count all words of the corpus in a table of fixed size; its counts give every
   line's words one global order, the rarest first.
2. Post each different set under the words of its prefix: the first n - ceil(t n) + 1
   in that order, one of which any matching set must share.  Words counted once and
   sets so small that only an equal set can reach the threshold are not posted.
3. In each word's list, keep pairs that pass the length filter, the positional
   filter and a bound from parity sketches of about as many bits as the sets have
   words, and that share no word before this one.  Sets in such a pair are flagged.
4. Post the flagged sets with all their words under the words they were flagged at
   and verify the Jaccard similarity of each pair in the list of the first prefix word
   they share, so each link is counted once.  A list returns one row for each set: its
   first match and its links.
5. Per set: the first occurrence of the set itself or of a match; all occurrences
   after it go.

Lists are keyed by 32 bits of the word's hash; words that share them share a list,
which adds pairs to check and loses none.  Equal sets are joined by a 128-bit key,
never expanded into pairs.  Lists of words with high counts are split into cells for
all pairs of salted parts, as many parts as the count asks for, so no list is gathered
in one task.  Nothing is capped.  Posts travel packed by shard: one binary value holds
many of them.

Null texts count as empty and stay null; lines without words never match; repeated
rows of an id with equal texts are one document, with different texts they are
ordered by a hash of the text.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import ship, stored, whole_groups

U64 = np.uint64
BUCKETS, CHUNK = 1 << 22, 1 << 16
THRESHOLD, LIST_ROWS, MOST_LEVEL = 0.8, 1 << 14, 11
#: bytes of packed sets that are expanded into posts at once; bytes of posts of a shard
FLUSH, SHARD = 4 << 20, 4 << 20


def _dense(rows: DataFrame, fill, size: int) -> np.ndarray:
    """Sum over all partitions of the array of fixed size that ``fill`` makes of a partition's batches."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fill(batches)
        kept = [k for k in range(size // CHUNK) if total[k * CHUNK : (k + 1) * CHUNK].any()]
        data = [zlib.compress(total[k * CHUNK : (k + 1) * CHUNK].astype("<u4").tobytes(), 1) for k in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                own = np.frombuffer(zlib.decompress(data.as_py()), "<u4").astype(np.uint64)
                sums[k] = sums[k] + own if k in sums else own
        data = [zlib.compress(np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    out = np.zeros(size, dtype=np.uint32)
    for row in rows.mapInArrow(part, "chunk int, data binary").repartition("chunk").mapInArrow(merge, "chunk int, data binary").toLocalIterator():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["data"]), "<u4")
    return out


def _bucket(h: np.ndarray, size: int = BUCKETS) -> np.ndarray:
    return (h >> U64(64 - size.bit_length() + 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of all words of column ``text``, by bucket of the word's hash."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in W.slices(batches, "text"):
            np.add.at(total, _bucket(W.folded_words(batch.column("text")).hashes()), 1)
        return total

    return _dense(docs.select("text"), fill, BUCKETS)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each bucket in the order of the counts; buckets of words counted once have a negative place."""
    rank = np.empty(len(counts), dtype=np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return np.where(counts > 1, rank, -1 - rank)


def least_size(threshold: float) -> int:
    """Words of the smallest set that a different set can match: n / (n + 1) has to reach the threshold."""
    return 1 << 40 if threshold >= 1 else max(1, int(np.ceil(threshold / (1 - threshold) - 1e-9)))


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (length[0] places), begin[1], .. : the places of ragged rows, end to end."""
    ends = _ends(length)
    return np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of the values, all lowest ones first: what small values leave zero compresses away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def _of_planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.view(np.uint8).reshape(values.itemsize, -1).T).view(values.dtype).ravel()


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", len(kinds)).tolist()
    out, at = [], 4 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class Lines:
    """The sets of the lines of a batch of texts, each in the global order."""

    def __init__(self, column: pa.Array, ranks: np.ndarray, threshold: float):
        folded, same = W.folded(column)
        breaks = np.flatnonzero(folded == 10) + 1
        # each text's lines: one more than its breaks
        per = np.searchsorted(breaks, same[1:], "right") - np.searchsorted(breaks, same[:-1], "right") + 1
        self.text = np.repeat(np.arange(len(per)), per)
        self.number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = np.repeat(np.searchsorted(breaks, same[:-1], "right"), per) + self.number - 1
        begin = np.where(self.number == 0, same[:-1][self.text], breaks[np.clip(first, 0, max(0, len(breaks) - 1))] if len(breaks) else 0)
        words = W.Words(folded, same)
        h = words.hashes()
        # words ascend, so each line's are a run
        line = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(words.start, begin), append=len(h)))
        rank = ranks[_bucket(h)]
        place = np.where(rank < 0, -1 - rank, rank).astype(U64)
        # the rank is a function of the hash's upper 22 bits; 20 lower ones tell words of one bucket apart, in every batch the same
        low = min(20, 42 - len(begin).bit_length())
        order = np.argsort((line.astype(U64) << U64(22 + low)) | (place << U64(low)) | (h & U64((1 << low) - 1)))
        h, line, rank = h[order], line[order], rank[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line, self.rank = h[new], line[new], rank[new]
        self.size = np.bincount(self.line, minlength=len(self.text))
        self.first = _ends(self.size)
        self.key1 = self._sums(W.mix(self.h))
        self.key2 = self._sums(W.mix(self.h * U64(0x9FB21C651E98DF25) + U64(1)))
        self.threshold = threshold

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def sketches(self, lines: np.ndarray) -> np.ndarray:
        """Of each given line: parities of the number of words in each of 32 * 2**level groups, end to end."""
        size = self.size[lines]
        level = sketch_level(size)
        ends = _ends(1 << level)
        own = _runs(self.first[lines], size)
        nth = np.repeat(np.arange(len(lines)), size)
        # the group's low bits are the same at every level, so a sketch folds onto a shorter one
        group = (self.h[own] & U64((32 << MOST_LEVEL) - 1)).astype(np.int64) & ((32 << level[nth]) - 1)
        bit = np.uint32(1) << (group & 31).astype(np.uint32)
        place = ends[:-1][nth] + (group >> 5)
        out = np.zeros(int(ends[-1]), dtype="<u4")
        if level.any():
            order = np.argsort(place, kind="stable")
            place, bit = place[order], bit[order]
        marks = np.flatnonzero(np.diff(place, prepend=-1))
        if len(marks):
            out[place[marks]] = np.bitwise_xor.reduceat(bit, marks)
        return out

    def packed(self, lines: np.ndarray, counts_of) -> bytes:
        """Keys, sizes, sketches and prefixes of the given lines: (k1, size, sketch, key, parts), a part number of 0 is not posted."""
        size = self.size[lines]
        at = _runs(self.first[lines], _prefix(size, self.threshold))
        rank = self.rank[at]
        parts = np.where(rank < 0, 0, np.maximum(1, -(-counts_of(self.h[at]) // LIST_ROWS)))
        return _pack(self.key1[lines], size.astype("<u4"), self.sketches(lines), (self.h[at] >> U64(32)).astype("<u4"), parts.astype("<u4"))


PACKED = ("<u8", "<u4", "<u4", "<u4", "<u4")
#: key, cell of the key's list, part (-1 in a list that is not split or holds one part), upper and lower bits of the set's key,
#: size, pos, posted keys before, all by bytes, and sketches and the posted keys before
POSTS = ("<u4", "<u8", "<i4", "<u4", "<u2", "<u4", "<u4", "<u4", "<u4", "<u4")


def _list(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return W.mix((key.astype(U64) << U64(32)) ^ W.mix(cell))


def _expanded(rows: list[bytes], threshold: float, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed posts) of packed sets."""
    parts_ = [_unpack(r, *PACKED) for r in rows]
    k1, size, sketch, key, parts = (np.concatenate(x) for x in zip(*parts_))
    size = size.astype(np.int64)
    prefix, words = _prefix(size, threshold), 1 << sketch_level(size)
    first_key, first_word = _ends(prefix)[:-1], _ends(words)[:-1]
    at = np.flatnonzero(parts)
    owner = np.repeat(np.arange(len(size)), prefix)
    # of each place of a prefix: posted keys before it; words counted once share their key with no other
    posted, so_far = key[at], _ends(parts > 0)
    first_posted = so_far[first_key]
    before = so_far[:-1] - first_posted[owner]
    owner = owner[at]
    times = parts[at].astype(np.int64)
    own = (W.mix(k1[owner] + U64(7)) % times.astype(U64)).astype(np.int64)
    # one row for each cell of the list: the pairs of the row's part with every part
    which = np.repeat(np.arange(len(at)), times)
    other = _runs(np.zeros(len(at), dtype=np.int64), times)
    lo, hi = np.minimum(own[which], other), np.maximum(own[which], other)
    at, owner, part = at[which], owner[which], np.where(lo != hi, own[which], -1)
    cell = (lo.astype(U64) << U64(32)) | hi.astype(U64)
    shard = (_list(key[at], cell) >> U64(32)) * U64(shards) >> U64(32)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1, dtype=U64)).tolist()
    pos = at - first_key[owner]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            o = order[a:b]
            s = owner[o]
            columns = (key[at[o]], cell[o], part[o].astype("<i4"), (k1[s] >> U64(32)).astype("<u4"), ((k1[s] >> U64(16)) & U64(0xFFFF)).astype("<u2"), size[s].astype("<u4"), pos[o].astype("<u4"), before[at[o]].astype("<u4"))
            yield k, _pack(*map(_planes, columns), sketch[_runs(first_word[s], words[s])], posted[_runs(first_posted[s], before[at[o]])])


def _posts(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["shard", "data"])


def sketch_level(size: np.ndarray) -> np.ndarray:
    """A sketch has about as many bits as the set has words."""
    return np.searchsorted(40 << np.arange(MOST_LEVEL), size, "left")


def _need(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _share(values: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether any of the na values from a on equals any of the nb values from b on, for each pair of runs."""
    out = np.zeros(len(a), dtype=bool)
    some = np.flatnonzero((na > 0) & (nb > 0))
    for lo in range(0, len(some), 1 << 14):
        x = some[lo : lo + (1 << 14)]
        pair = np.repeat(np.arange(len(x)), na[x])
        left = values[_runs(a[x], na[x])]
        n = nb[x][pair]
        right = values[_runs(b[x][pair], n)]
        out[x[pair[np.repeat(np.arange(len(pair)), n)[np.repeat(left, n) == right]]]] = True
    return out


def _candidates(rows: list[bytes], threshold: float) -> tuple[np.ndarray, ...]:
    """(48 bits of k1, list, pos, part) of the posts that pass all filters with another post of their list."""
    columns = list(zip(*(_unpack(r, *POSTS) for r in rows)))
    key, cell, part, high, low, size, pos, n_before = (np.concatenate([_of_planes(x) for x in c]) for c in columns[:8])
    sketch, before = (np.concatenate(c) for c in columns[8:])
    k1, lists = (high.astype(U64) << U64(16)) | low, _list(key, cell)
    size, pos, n_before = (x.astype(np.int64) for x in (size, pos, n_before))
    level = sketch_level(size)
    begin, first = _ends(1 << level)[:-1], _ends(n_before)[:-1]
    order = np.argsort((size.astype(U64) << U64(48)) | k1)
    order = order[np.argsort(lists[order], kind="stable")]
    new = np.ones(len(order), dtype=bool)
    # equal sets: 48 bits of the key, the size and the first 32 bits of the sketch
    new[1:] = (lists[order[1:]] != lists[order[:-1]]) | (k1[order[1:]] != k1[order[:-1]]) | (size[order[1:]] != size[order[:-1]]) | (sketch[begin[order[1:]]] != sketch[begin[order[:-1]]])
    order = order[new]
    lists, part, k1, size, pos, level, begin, first, n_before = (x[order] for x in (lists, part, k1, size, pos, level, begin, first, n_before))

    def differing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the rows differ, on the shorter one's level (that of i)."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in np.unique(level[i]).tolist():
            some = np.flatnonzero(level[i] == k)
            a, b, further = begin[i[some]], begin[j[some]], level[j[some]] - k
            for word in range(1 << k):
                other = sketch[b + word]
                for fold in range(1, 1 << int(further.max())):
                    longer = fold < 1 << further
                    other = np.where(longer, other ^ sketch[np.where(longer, b + word + (fold << k), b)], other)
                out[some] += np.bitwise_count(sketch[a + word] ^ other)
        return out

    marked = np.zeros(len(order), dtype=bool)
    i, step = np.arange(len(order)), 1
    while True:
        i = i[i + step < len(order)]
        j = i + step
        going = (lists[i] == lists[j]) & (size[i] >= threshold * size[j] - 1e-9)
        i, j = i[going], j[going]
        if not len(i):
            return k1[marked], lists[marked], pos[marked], part[marked]
        need = _need(size[i], size[j], threshold)
        ok = (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need) & ((part[i] < 0) | (part[i] != part[j])) & ~(marked[i] & marked[j])
        some = np.flatnonzero(ok)
        some = some[size[i[some]] + size[j[some]] - differing(i[some], j[some]) >= 2 * need[some]]
        a, b = i[some], j[some]
        mine = ~_share(before, first[a], n_before[a], first[b], n_before[b])
        marked[a[mine]] = marked[b[mine]] = True
        step += 1


class Sets:
    """Rows of sorted lists with the words of their sets; finds the pairs that match."""

    def __init__(self, rows: pa.RecordBatch, threshold: float):
        self.threshold = threshold
        _, offsets, data = rows.column("words").buffers()
        ends = np.frombuffer(offsets, np.int32)[rows.column("words").offset :][: rows.num_rows + 1] // 8
        self.values = np.frombuffer(data, U64)
        self.keys = (self.values >> U64(32)).astype(np.uint32)
        self.place = np.unique(self.values, return_inverse=True)[1].astype(U64)
        self.begin, self.size = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
        self.pos, self.part = (rows.column(c).to_numpy().astype(np.int64) for c in ("pos", "part"))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words that rows i and j share."""
        out = np.zeros(len(i), dtype=np.int64)
        done = 0
        while done < len(i):
            upto = max(done + 1, int(np.searchsorted(np.cumsum((self.size[i] + self.size[j])[done:]), 1 << 20)) + done)
            a, b = i[done:upto], j[done:upto]
            pair = np.concatenate([np.repeat(np.arange(len(a), dtype=U64), self.size[x]) for x in (a, b)])
            word = np.concatenate([self.place[_runs(self.begin[x], self.size[x])] for x in (a, b)])
            both = np.sort((pair << U64(32)) | word)
            same = both[1:][both[1:] == both[:-1]]
            out[done:upto] = np.bincount((same >> U64(32)).astype(np.int64), minlength=len(a))
            done = upto
        return out

    def matching(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows of a list, those that match and share no prefix word before the list's."""
        a, b = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        ok = (a >= self.threshold * b - 1e-9) & ((self.part[i] < 0) | (self.part[i] != self.part[j]))
        i, j = i[ok], j[ok]
        ok = self.shared(i, j) >= _need(self.size[i], self.size[j], self.threshold)
        i, j = i[ok], j[ok]
        first = ~_share(self.keys, self.begin[i], self.pos[i], self.begin[j], self.pos[j])
        return i[first], j[first]

    def dense(self, lo: int, hi: int, most: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """matching() for all pairs of rows lo..hi of one list, by products of blocks of at most ``most`` cells."""
        marks = [lo]
        for row in range(lo, hi):
            words = self.begin[row] + self.size[row] - self.begin[marks[-1]]
            if row > marks[-1] and ((row + 1 - marks[-1]) * 2 * words > most or row - marks[-1] >= 1024):
                marks.append(row)
        blocks = list(zip(marks, [*marks[1:], hi]))
        for n, (a, a2) in enumerate(blocks):
            for b, b2 in blocks[n:]:
                wa, wb = (self.place[self.begin[x] : self.begin[y - 1] + self.size[y - 1]] for x, y in ((a, a2), (b, b2)))
                kinds, place = np.unique(np.concatenate([wa, wb]), return_inverse=True)
                left, right = np.zeros((a2 - a, len(kinds)), np.float32), np.zeros((b2 - b, len(kinds)), np.float32)
                left[np.repeat(np.arange(a2 - a), self.size[a:a2]), place[: len(wa)]] = 1
                right[np.repeat(np.arange(b2 - b), self.size[b:b2]), place[len(wa) :]] = 1
                ok = left @ right.T >= _need(self.size[a:a2, None], self.size[None, b:b2], self.threshold)
                ok &= (self.part[a:a2, None] < 0) | (self.part[a:a2, None] != self.part[None, b:b2])
                if a == b:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                first = ~_share(self.keys, self.begin[i], self.pos[i], self.begin[j], self.pos[j])
                yield i[first], j[first]


def _verified(rows: pa.RecordBatch, threshold: float, small: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For whole lists with distinct sets: rows with links, the row of each one's first match, its links."""
    n = rows.num_rows
    sets = Sets(rows, threshold)
    lists = rows.column("list").to_numpy()
    rank = np.empty(n, dtype=np.int64)
    sort_keys = [(c, "ascending") for c in ("first_id", "first_text", "first_line")]
    rank[pa.compute.sort_indices(pa.Table.from_batches([rows]), sort_keys=sort_keys, null_placement="at_start").to_numpy()] = np.arange(n)
    by_rank = np.argsort(rank)
    best, links = np.full(n, n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(links, x, 1)
        np.add.at(links, y, 1)
        np.minimum.at(best, x, rank[y])
        np.minimum.at(best, y, rank[x])

    marks = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    ends = np.append(marks[1:], n)
    large = ends - marks > small
    for lo, hi in zip(marks[large].tolist(), ends[large].tolist()):
        for x, y in sets.dense(lo, hi):
            add(x, y)
    upto = np.where(large, marks, ends)[np.repeat(np.arange(len(marks)), ends - marks)]
    i = np.arange(n)
    per = np.maximum(upto - i - 1, 0)
    left = np.repeat(i, per)
    for lo in range(0, len(left), 1 << 18):
        x = left[lo : lo + (1 << 18)]
        add(*sets.matching(x, _runs(i + 1, per)[lo : lo + (1 << 18)]))
    some = np.flatnonzero(links)
    return some, by_rank[best[some]], links[some]


def line_table(docs: DataFrame, counts, threshold: float) -> DataFrame:
    """(id, h, line, k1, k2, packed) of every line with words, and rows of packed sets with line -1.

    A set is packed at its first line in a partition only.
    """
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("line", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("k1", "k2")], T.StructField("packed", T.BinaryType())])
    least = least_size(threshold)
    places = docs.sparkSession.sparkContext.broadcast(_ranks(counts.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = places.value, np.zeros(1 << 16, dtype=U64)
        counts_of = lambda h: counts.value[_bucket(h)].astype(np.int64)
        for batch in W.slices(batches, "text"):
            lines = Lines(batch.column("text"), ranks, threshold)
            some = np.flatnonzero(lines.size)
            text = pa.array(lines.text[some])
            columns = [
                batch.column("id").take(text),
                batch.column("h").take(text),
                pa.array(lines.number[some].astype(np.int32)),
                pa.array(lines.key1[some].view(np.int64)),
                pa.array(lines.key2[some].view(np.int64)),
                pa.nulls(len(some), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            some = some[lines.size[some] >= least]
            # sets met lately are known by their place in a table of fixed size; what it forgets is posted again
            some = some[np.unique(lines.key1[some], return_index=True)[1]]
            key = lines.key1[some]
            place = (key >> U64(48)).astype(np.int64)
            some = np.sort(some[seen[place] != key])
            seen[place] = key
            if len(some):
                one = [pa.nulls(1, columns[0].type), *[pa.array([v], t) for v, t in ((0, pa.int64()), (-1, pa.int32()), (0, pa.int64()), (0, pa.int64()), (lines.packed(some, counts_of), pa.binary()))]]
                yield pa.RecordBatch.from_arrays(one, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def flagged(table: DataFrame, threshold: float) -> DataFrame:
    """(k48, list, pos, part) of the sets that pass all filters with some other set, and the lists in which they do; ``k48`` is k1's upper bits."""
    spark = table.sparkSession
    packed = table.where("line = -1").select("packed")
    size = packed.agg(F.sum(F.length("packed"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-8 * size // SHARD))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            found, size = [], 0
            for k, data in _expanded(held, threshold, shards) if held else ():
                found.append((k, data))
                size += len(data)
                # posts are several times their sets
                if size >= FLUSH:
                    yield _posts(found)
                    found, size = [], 0
            yield _posts(found)

        held: list[bytes] = []
        for batch in batches:
            for value in batch.column("packed"):
                held.append(value.as_py())
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
                    held = []
                    W.give_back()
        yield from flush()
        W.give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> pa.RecordBatch:
            k1, lists, pos, part = _candidates(held, threshold)
            return pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(lists.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(part)], names=["k48", "list", "pos", "part"])

        held: list[bytes] = []
        at = None
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                if held and shard != at:
                    yield solved()
                    held = []
                at = shard
                held.append(data.as_py())
        if held:
            yield solved()
        W.give_back()

    posts = packed.mapInArrow(expand, "shard int, data binary").repartition(shards, "shard").sortWithinPartitions("shard")
    return posts.mapInArrow(run, "k48 long, list long, pos int, part int")


def _place(of_id: np.ndarray, h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of the occurrence of a line."""
    return W.mix(of_id.view(U64) + W.mix(h.view(U64) + line.astype(U64)))


def picked(column: pa.Array, marked) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, number, line) of the lines of a batch of texts whose text and number are ``marked``."""
    data, offsets = W.utf8(column)
    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    text = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.where(number == per[text] - 1, offsets[1:][text], np.append(begin[1:], 0) - 1)
    some = np.flatnonzero(marked(text, number))
    length = (end - begin)[some]
    lines = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(_ends(length)), pa.py_buffer(data[_runs(begin[some], length)])])
    return text[some], number[some], lines


def decisions(docs: DataFrame, counts, table: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """(k1, k2, best, links): of each set with links, its first matching set's first occurrence and its links."""
    spark = docs.sparkSession
    posts = flagged(table, threshold).groupBy("k48").agg(F.collect_list(F.struct("list", "pos", "part")).alias("posts"))
    marks = firsts.join(posts.hint("shuffle_hash"), F.shiftrightunsigned("k1", 16) == F.col("k48")).select("k1", "k2", "first", F.xxhash64("first.id").alias("of_id"), F.col("first.h").alias("h"), F.col("first.line").alias("line"), "posts")
    marks = stored(marks, "line-candidates")

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total[_bucket(_place(*(batch.column(c).to_numpy() for c in ("of_id", "h", "line"))))] = 1
        return total

    # a bit table of fixed size spares most lines the way; what it lets pass too much, the join drops
    maybe = spark.sparkContext.broadcast(np.packbits(_dense(marks.select("of_id", "h", "line"), fill, BUCKETS) > 0))
    places = spark.sparkContext.broadcast(_ranks(counts.value))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(maybe.value).astype(bool)
        for batch in W.slices(batches, "text"):
            of_id, h = (batch.column(c).to_numpy() for c in ("of_id", "h"))
            # words are looked for in marked lines only
            text, number, own = picked(batch.column("text"), lambda text, number: bits[_bucket(_place(of_id[text], h[text], number))])
            lines = Lines(own, places.value, threshold)
            some = np.flatnonzero(lines.size)
            text, number = text[some], number[some]
            words = lines.h[_runs(lines.first[some], lines.size[some])]
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * _ends(lines.size[some])).astype(np.int32)), pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([pa.array(lines.key1[some].view(np.int64)), pa.array(lines.key2[some].view(np.int64)), pa.array(of_id[text]), pa.array(h[text]), pa.array(number.astype(np.int32)), packed], names=["k1", "k2", "of_id", "h", "line", "words"])

    rows = docs.withColumn("of_id", F.xxhash64("id")).mapInArrow(sets, "k1 long, k2 long, of_id long, h long, line int, words binary")
    # equal rows of a document give equal rows, which a list drops
    rows = rows.join(marks, ["k1", "k2", "of_id", "h", "line"]).select("k1", "k2", F.col("first.id").alias("first_id"), F.col("h").alias("first_text"), F.col("line").alias("first_line"), "words", F.explode("posts").alias("post"))
    posted = rows.select("post.list", "post.pos", "post.part", "k1", "k2", "first_id", "first_text", "first_line", "words")
    kind = firsts.schema["first"].dataType["id"].dataType
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("links", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["list"]):
            keys = np.stack([rows.column(c).to_numpy() for c in ("list", "k1", "k2")])
            new = np.ones(rows.num_rows, dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            if not new.all():
                rows = rows.filter(pa.array(new))
            at, best, links = _verified(rows, threshold)
            if len(at):
                own, other = rows.take(pa.array(at)), rows.take(pa.array(best))
                yield pa.RecordBatch.from_arrays([own.column("k1"), own.column("k2"), other.column("first_id"), other.column("first_text"), other.column("first_line"), pa.array(links)], names=schema.fieldNames())

    found = posted.repartition("list").sortWithinPartitions("list", "k1", "k2").mapInArrow(run, schema)
    return found.groupBy("k1", "k2").agg(F.min(F.struct("id", "h", "line")).alias("best"), F.sum("links").alias("links"))


def lines_found(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, h, line, removed, class, links) of every line that repeats or matches another.

    ``h`` is a hash of the text; ``class`` is the occurrence (id, h, line) that the
    line's set is measured against: the first of its own and its matches' occurrences.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(docs[key].alias("id"), F.xxhash64(docs[text].cast("string")).alias("h"), docs[text].cast("string").alias("text")).where("text is not null")
    counts = spark.sparkContext.broadcast(word_counts(source))
    table = stored(line_table(source, counts, threshold), "lines")
    lines = table.where("line >= 0")
    firsts = stored(lines.groupBy("k1", "k2").agg(F.min(F.struct("id", "h", "line")).alias("first"), F.count("*").alias("n")), "line-sets")
    found = decisions(source, counts, table, firsts, threshold)
    sets = firsts.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").where("n > 1 or links > 0").select("k1", "k2", F.least("first", F.coalesce("best", "first")).alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    sets = stored(sets, "line-classes")
    own = lines.select("id", "h", "line", "k1", "k2", F.struct("id", "h", "line").alias("at"))
    return own.join(sets.hint("shuffle_hash"), ["k1", "k2"]).select("id", "h", "line", (F.col("at") > F.col("class")).alias("removed"), "class", "links")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(row, text, n_lines, removed_lines, n_links): each row of ``docs`` as a struct, and its text without the removed lines.

    A null text stays null and has no lines.
    """
    found = lines_found(docs, key, text, threshold)
    per_doc = found.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line")))).alias("gone"), F.sum("links").alias("n_links"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), F.xxhash64(docs[text].cast("string")).alias("th"))
    # texts are not sorted: a partition's removed lines are looked up in a table
    joined = rows.join(per_doc.hint("shuffle_hash"), rows["k"].eqNullSafe(per_doc["id"]) & (rows["th"] == per_doc["h"]), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    # the text travels once, in its row
    whole = F.col("row")[text].cast("string")
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    # only a text that loses lines is cut, once: what a function over places names is worked out for each of them
    cut = F.array(F.struct(F.split(whole, "\n", -1).alias("lines"), F.array_except(F.sequence(F.lit(0), breaks), gone).alias("stay")))
    kept = F.array_join(F.flatten(F.transform(cut, lambda own: F.transform(own["stay"], lambda i: F.get(own["lines"], i)))), "\n")
    return joined.select(
        "row",
        F.when(F.size(gone) > 0, kept).otherwise(whole).alias("text"),
        F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"),
        gone.alias("removed_lines"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
