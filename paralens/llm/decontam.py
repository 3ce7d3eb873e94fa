"""Benchmark decontamination with SimHash over item-sized windows.

Words are the lower-cased text without ASCII punctuation; shingles are runs of five
words (a shorter sequence is one shingle).  For an item of L words the windows of a
document are its runs of L words (the whole document if it is shorter).

Every window that could hold any item is fingerprinted, and its fingerprint is looked
up among those of all items of its size: the multi-index over blocks of the
fingerprints gives all items within the radius (a fingerprint within it differs in at
most radius // blocks bits of some block).  The exact weighted similarity of these
items, sum(min)/sum(max) over shingle counts, then decides.  A window that reaches the
threshold shares at least threshold / (1 + threshold) of the joint shingles with its
item, so windows in which fewer shingles occur in any item at all are passed over;
none that could match is lost.

Items are processed in groups of at most ``group_bytes`` of text, each group with a
pass of its own whose rows are written before the next, so what is sent to the
executors and held by the driver is bounded for any benchmark.

Null or wordless texts and items match nothing; repeated documents and items keep
their rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import ship, stored, text_and_id

U64 = np.uint64
#: words of a shingle, least similarity, fingerprint radius, blocks of a fingerprint
SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 19, 4


def shingle_bits(h: np.ndarray) -> np.ndarray:
    """(n, 64): +1 for a set bit, -1 for a clear one."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of summed bits."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8")[..., 0].astype(U64)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (length[0] places), begin[1], .. : the places of ragged rows, end to end."""
    ends = _ends(length)
    return np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)


class HammingBlocks:
    """Multi-index over fingerprints: for each block and block value, the members within the block's share of the radius."""

    def __init__(self, codes: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.codes, self.radius, self.blocks, self.width = codes, radius, blocks, 64 // blocks
        flips = [sum(1 << b for b in bits) for n in range(radius // blocks + 1) for bits in combinations(range(self.width), n)]
        self.flips = np.array(flips, dtype=np.int64)
        #: of each block: members by block value, the different values, where each one's members begin
        self.order, self.values, self.begin = [], [], []
        for k in range(blocks):
            part = self._part(codes, k)
            self.order.append(np.argsort(part, kind="stable"))
            values, begin = np.unique(part[self.order[k]], return_index=True)
            self.values.append(values)
            self.begin.append(np.append(begin, len(codes)))

    def _part(self, codes: np.ndarray, k: int) -> np.ndarray:
        return ((codes >> U64(k * self.width)) & U64((1 << self.width) - 1)).astype(np.int64)

    def _probed(self, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of a block value) of all values within the block's share of the radius."""
        values = self.values[k]
        if len(values) <= len(self.flips):
            return np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= self.radius // self.blocks)
        wanted = part[:, None] ^ self.flips[None, :]
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        q, flip = np.nonzero(values[at] == wanted)
        return q, at[q, flip]

    def search(self, codes: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all pairs within the radius, by query and member."""
        found = []
        n = len(self.codes)
        step = max(1, most // max(1, min(n, len(self.flips))))
        for lo in range(0, len(codes), step):
            some = codes[lo : lo + step]
            pairs = [np.zeros(0, dtype=np.int64)]
            for k in range(self.blocks):
                q, at = self._probed(self._part(some, k), k)
                per = self.begin[k][at + 1] - self.begin[k][at]
                pairs.append(np.repeat(q, per) * n + self.order[k][_runs(self.begin[k][at], per)])
            pairs = np.unique(np.concatenate(pairs))
            near = np.bitwise_count(some[pairs // n] ^ self.codes[pairs % n]) <= self.radius
            found.append(pairs[near] + lo * n)
        pairs = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return pairs // max(1, n), pairs % max(1, n)

    def near(self, code: int) -> np.ndarray:
        """Places of all members within the radius of one code, ascending."""
        return self.search(np.array([code], dtype=U64))[1]


class Items:
    """Benchmark items ready for the search."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float, radius: int):
        self.ids, self.threshold = ids, threshold
        words = W.folded_words(pa.array(texts, pa.string()))
        h = words.hashes()
        shingles = []
        codes = np.zeros(len(ids), dtype=U64)
        for i, n in enumerate(words.count.tolist()):
            shingles.append(_grams(h[words.first[i] : words.first[i] + n], min(SHINGLE, n)) if n else np.zeros(0, dtype=U64))
            if n:
                codes[i] = fingerprint(shingle_bits(shingles[i]).sum(axis=0))
        #: shingles of the items, end to end
        self.begin, self.n, self.shingles = _ends([len(x) for x in shingles])[:-1], np.array([len(x) for x in shingles], dtype=np.int64), np.concatenate([np.zeros(0, U64), *shingles])
        #: by words of a shingle: the shingles of all items, a bit table of them, and for each number of words the items of this size and their index
        self.by_shingle: dict[int, tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, HammingBlocks]]]] = {}
        sizes = np.minimum(words.count, SHINGLE)
        for k in np.unique(sizes[sizes > 0]).tolist():
            keys = np.unique(self.shingles[_runs(self.begin[sizes == k], self.n[sizes == k])])
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(keys >> U64(44)).astype(np.int64)] = True
            by_size = {}
            for size in np.unique(words.count[sizes == k]).tolist():
                members = np.flatnonzero(words.count == size)
                by_size[size] = (members, HammingBlocks(codes[members], radius))
            self.by_shingle[k] = (keys, seen, by_size)

    def matches(self, words: W.Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): each text's best window for each item it holds, the first of equals."""
        h = words.hashes()
        found = []
        for k, (keys, seen, by_size) in self.by_shingle.items():
            g, at = W.grams(words, h, k)
            some = np.flatnonzero(seen[(g >> U64(44)).astype(np.int64)])
            some = some[keys[np.minimum(np.searchsorted(keys, g[some]), len(keys) - 1)] == g[some]]
            if not len(some):
                continue
            hits = at[some]
            windows = {size: self._windows(words, hits, size, k) for size in by_size}
            windows = {size: w for size, w in windows.items() if len(w[0])}
            if not windows:
                continue
            # shingles of all windows; a window's are neighbours among them, so differences of sums are its sums
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            for start, n in windows.values():
                np.add.at(marks, start, 1)
                np.add.at(marks, start + n, -1)
            used = np.cumsum(marks[:-1]) > 0
            of_word = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(used, out=of_word[1:])
            own = g[np.searchsorted(at, np.flatnonzero(used))]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(shingle_bits(own), axis=0, dtype=np.int32)])
            for size, (start, n) in windows.items():
                members, index = by_size[size]
                a = of_word[start]
                for lo in range(0, len(start), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    w, member = index.search(fingerprint(sums[a[part] + n[part]] - sums[a[part]]))
                    if len(w):
                        w, item = w + lo, members[member]
                        sim = self._similarity(own, a[w], n[w], item)
                        ok = sim >= self.threshold
                        w, item, sim = w[ok], item[ok], sim[ok]
                        found.append((words.owner[start[w]], item, -sim, start[w], n[w] + k - 1))
        if not found:
            return
        text, item, sim, start, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, sim, item, text))
        order = order[(np.diff(text[order], prepend=-1) != 0) | (np.diff(item[order], prepend=-1) != 0)]
        yield from zip(text[order].tolist(), item[order].tolist(), (start[order] - words.first[text[order]]).tolist(), size[order].tolist(), (-sim[order]).tolist())

    def _windows(self, words: W.Words, hits: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of shingles of the windows for items of ``size`` words in which enough shingles are some item's."""
        n = size - k + 1
        need = _need(n, n, self.threshold)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(hits) >= need:
            first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
            owner = words.owner[first]
            ok = (last - first < n) & (owner == words.owner[last]) & (words.count[owner] >= size)
            first, last, owner = first[ok], last[ok], owner[ok]
            lo, hi = np.maximum(last - n + 1, words.first[owner]), np.minimum(first, words.first[owner + 1] - size)
            start = np.unique(_runs(lo, np.maximum(hi - lo + 1, 0)))
            out.append((start, np.full(len(start), n)))
        # a text that is shorter than the item is one window
        text, count = np.unique(words.owner[hits], return_counts=True)
        own = words.count[text] - k + 1
        some = (own < n) & (count >= np.ceil(self.threshold / (1 + self.threshold) * (own + n) - 1e-9))
        out.append((words.first[text[some]], own[some]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _similarity(self, own: np.ndarray, a: np.ndarray, n: np.ndarray, item: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Weighted similarity of the windows own[a : a + n] and the items."""
        out = np.zeros(len(a))
        total = n + self.n[item]
        done, ends = 0, np.cumsum(total)
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most)))
            x, i = slice(done, upto), item[done:upto]
            of_windows, of_items = own[_runs(a[x], n[x])], self.shingles[_runs(self.begin[i], self.n[i])]
            rank = np.unique(np.concatenate([of_windows, of_items]), return_inverse=True)[1]
            pairs = np.arange(len(i))
            left, n_left = np.unique((np.repeat(pairs, n[x]) << 32) | rank[: len(of_windows)], return_counts=True)
            right, n_right = np.unique((np.repeat(pairs, self.n[i]) << 32) | rank[len(of_windows) :], return_counts=True)
            at = np.minimum(np.searchsorted(right, left), len(right) - 1)
            same = right[at] == left
            both = np.bincount(left[same] >> 32, np.minimum(n_left[same], n_right[at[same]]), len(i))
            out[x] = both / (total[x] - both)
            done = upto
        return out


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n within one sequence, as words.grams gives them."""
    last = len(h) - n + 1
    out = np.zeros(last, dtype=U64)
    for k in range(n):
        out = (out ^ (out >> U64(29))) * U64(0xBF58476D1CE4E5B9) + h[k : k + last]
    return W.mix(out)


def _need(a: int, b: int, threshold: float) -> int:
    """Shared shingles that sets of a and b must have at least."""
    return int(np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9))


def item_groups(benchmark: DataFrame, key: str, text: str, group_bytes: int) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of the benchmark in groups of bounded size."""
    ids, texts, held = [], [], 0
    for row in text_and_id(benchmark, key, text).toLocalIterator():
        ids.append(row["id"])
        texts.append(row["text"])
        held += len(row["text"] or "") + 32
        if held >= group_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, group_bytes: int = 8 << 20) -> DataFrame:
    """(id, item, first_word, n_words, similarity): for each document and item found in it, the best window."""
    ship(docs.sparkSession)
    source = text_and_id(docs, key, text)
    schema = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("item", benchmark.schema[item_key].dataType),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def search(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches, "text"):
                found = list(items.matches(W.folded_words(batch.column("text"))))
                if found:
                    t, i, first, size, sim = zip(*found)
                    columns = [batch.column("id").take(pa.array(t)), pa.array([items.ids[x] for x in i]), pa.array(first), pa.array(size), pa.array(sim)]
                    yield pa.RecordBatch.from_arrays([c.cast(f) for c, f in zip(columns, [columns[0].type, columns[1].type, pa.int64(), pa.int64(), pa.float64()])], names=schema.fieldNames())

        return source.mapInArrow(run, schema)

    parts, first = [], None
    for ids, texts in item_groups(benchmark, item_key, item_text, group_bytes):
        if first is not None:
            parts.append(stored(first, "item-matches"))
        first = search(Items(ids, texts, threshold, radius))
    if first is None:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [*parts, stored(first, "item-matches") if parts else first])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, group_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item was found."""
    ship(docs.sparkSession)
    for k, (ids, texts) in enumerate(item_groups(benchmark, item_key, item_text, group_bytes)):
        docs = stored(docs, "without-items") if k else docs
        docs = docs.where(_clean(Items(ids, texts, threshold, radius))(docs[text].cast("string")))
    return docs


def _clean(items: Items):
    """A column function: whether a text holds none of the items."""

    def clean(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            out = np.ones(len(array), dtype=bool)
            done = 0
            for batch in W.slices(iter([pa.RecordBatch.from_arrays([array], names=["text"])]), "text"):
                for found in items.matches(W.folded_words(batch.column("text"))):
                    out[done + found[0]] = False
                done += batch.num_rows
            yield pa.array(out)

    clean.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(clean, "boolean")
