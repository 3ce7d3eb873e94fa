"""Toxicity from class-conditional Kneser-Ney counts of words and bigrams.

Labelled rows give bigram counts of each class over all their whole texts, and
continuation counts of words (after how many different words a word stands).  Every
counted bigram and word has a discounted probability in each class that backs off to
the share that it has of both classes' counts:

    p_c(x) = (n_c(x) - d_c(n_c(x))) / n_c + back_c * n(x) / n

with discounts for counts of one, two and more from the counts of counts.  Its
evidence is the logarithm of p_toxic / p_ordinary, times g / (g + CAUTION), where g is
twice the log-likelihood ratio of its two counts against the shared proportion: what
chance explains counts for little, but nothing that was counted is left out.

A text's evidence is summed over all its words and over all its bigrams, each as often
as it occurs; sums by length and fourth-power norms (which follow the strongest
expressions) go through a logistic fit on a bounded sample of other labelled rows.

Counts are packed by shard of a hash and summed there.  Expressions with at least
2**-FREQUENT of all occurrences, of which there are no more than 2**FREQUENT, are
broadcast and looked up where the texts are; all others meet the texts' expressions in
shards, as many as the counted expressions and the texts ask for, and each shard
returns a few sums for each text.  A bit table of fixed size spares expressions that
were never counted the way; it loses none that was, and spares less the more there are.  Keys have 16 bits more than the number of counted
expressions (48 at most), so an expression that was never counted is taken for a
counted one with a chance of 2**-16.

Rows are dealt by crc32 of the id: remainders 0 and 1 (of 4) train the models, 3 the
fit; 2 is held out and never learnt from.  Ids, languages and sources are never
inputs.  Null and empty texts score as texts without evidence; if a class has no
labelled row, every score is 0.  Repeated labels of an id count as toxic if one is.
A column of the score's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import ship, stored

U64 = np.uint64
DISCOUNT, CAUTION, HELD_OUT, FIT, FOLDS = 0.75, 10.0, 2, 3, 4
#: labelled rows of the fit, by order of a hash of their ids; labels that are broadcast for the join at most
FIT_ROWS, BROADCAST_LABELS = 20_000, 2_000_000
#: counted expressions of a shard; bytes of text whose expressions are dealt together; the least share of a broadcast expression
SHARD_KEYS, SLICE, FREQUENT = 1 << 20, 1 << 22, 18
#: bytes of text for which there is a shard; bits of the places in the bit table
SHARD_BYTES, TABLE = 1 << 26, 27
COUNTED = "shard int, codes binary, counts binary"
PACKED = "shard int, kind int, slice long, keys binary, one binary, other binary"
SUMS = ("n_words", "n_pairs", "words", "words4", "pairs", "pairs4")
CLASSES = ("toxic", "ordinary")


def fold(key: str):
    """The part of the labelled rows to which an id belongs."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS))


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of each text: 32-bit hashes of the word before (0 at the start) and of the word, and its text."""
    words = W.folded_words(column)
    v = (words.hashes() >> U64(32)).astype(U64)
    u = np.concatenate([np.zeros(1, U64), v[:-1]]) if len(v) else v
    u[words.first[:-1][words.count > 0]] = 0
    return u, v, words.owner


def features(sums: dict):
    """What the logistic fit sees, from numpy arrays or columns: evidence by length and by its root, and its norm."""
    out = []
    for kind in ("words", "pairs"):
        n = sums[f"n_{kind}"]
        out += [sums[kind] / n, sums[kind] / n**0.5, sums[f"{kind}4"] ** 0.25]
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method on standardised columns."""
    mean, scale = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / scale], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    out = w.copy()
    out[1:] /= scale
    out[0] -= (w[1:] * mean / scale).sum()
    return out


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(id, text, toxic, fold) of the labelled documents that may be learnt from."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    marks = marks.withColumn("fold", fold("id")).where(F.col("fold") != HELD_OUT)
    source = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    # labels of a checked size are broadcast; more of them meet the texts in a shuffle
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return source.join(F.broadcast(marks) if small else marks, "id")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one by one, as Python values."""
    return (tuple(v.as_py() for v in row) for row in zip(*batch.columns))


def _planes(values: np.ndarray) -> bytes:
    """The values compressed by their bytes, all lowest ones first."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _of_planes(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _ascending(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys, as steps."""
    return _planes(np.diff(keys, prepend=U64(0)))


def _of_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(data, "<u8"), dtype=U64)


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, ascending, and the sums of their columns of counts."""
    order = np.argsort(codes)
    codes = codes[order]
    marks = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[marks], np.add.reduceat(counts[:, order], marks, axis=1) if len(codes) else counts


def _counted(codes: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Ascending codes and rows of their counts, packed by shard."""
    ends = np.searchsorted((codes >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64)).tolist()
    rows = [(k, _ascending(codes[a:b]), _planes(np.ascontiguousarray(counts[:, a:b]).astype("<i8").ravel())) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], names=["shard", "codes", "counts"])


def _uncounted(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = _of_ascending(codes)
    return codes, _of_planes(counts, "<i8").reshape(-1, len(codes))


def _merged(rows: DataFrame, shards: int) -> DataFrame:
    """Packed counts with one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            codes, counts = _added(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held], axis=1))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_ascending(codes)], pa.binary()), pa.array([_planes(np.ascontiguousarray(counts).ravel())], pa.binary())], names=["shard", "codes", "counts"])

        held: list[tuple] = []
        at, size = None, 0
        for batch in batches:
            for shard, codes, counts in _rows(batch):
                if held and shard != at:
                    yield flush()
                    held, size = [], 0
                at = shard
                held.append(_uncounted(codes, counts))
                size += len(held[-1][0])
                if size > 1 << 21 and len(held) > 1:
                    held = [_added(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held], axis=1))]
                    size = len(held[0][0]) // 2
        if held:
            yield flush()

    return rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, COUNTED)


def _shards(rows: DataFrame, shard_bytes: int) -> int:
    """Shards by the bytes of the rows' texts."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes))


def pair_counts(rows: DataFrame, held_keys: int = 1 << 20) -> DataFrame:
    """Packed counts (toxic, ordinary) of every bigram of the rows' texts, keyed by mixed pairs of 32-bit hashes."""
    ship(rows.sparkSession)
    shards = _shards(rows, SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return _counted(*_added(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held], axis=1)), shards)

        for batch in W.slices(batches, "text"):
            u, v, owner = bigrams(batch.column("text"))
            if not len(u):
                continue
            toxic = (batch.column("toxic").to_numpy()[owner] > 0).astype(np.int64)
            held.append(_added(W.mix((u << U64(32)) | v), np.stack([toxic, 1 - toxic])))
            size += len(held[-1][0])
            if size >= held_keys:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return _merged(rows.select("text", "toxic").mapInArrow(run, COUNTED), shards)


def word_counts(pairs: DataFrame, shards: int) -> DataFrame:
    """Packed continuation counts (toxic, ordinary) and occurrences of every word, from packed counts of bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, counts in _rows(batch):
                codes, counts = _uncounted(codes, counts)
                words = W.mix(W.unmix(codes) & U64(0xFFFFFFFF))
                yield _counted(*_added(words, np.concatenate([counts > 0, counts.sum(axis=0, keepdims=True)])), shards)

    return _merged(pairs.mapInArrow(run, COUNTED), shards)


def keys_of(codes: np.ndarray, pairs: bool, bits: int = 48) -> np.ndarray:
    """Keys of mixed codes of words or bigrams; the last bit tells which."""
    return (codes >> U64(65 - bits) << U64(1)) | U64(pairs)


class Counts:
    """Totals and discounts of the classes, for words or for bigrams."""

    def __init__(self, row: dict, kind: str):
        self.total, self.discount, self.back = {}, {}, {}
        for c in CLASSES:
            n1, n2, n3, n4, more = (float(row[f"{kind}_{c}_{k}"] or 0) for k in (1, 2, 3, 4, "more"))
            self.total[c] = float(row[f"{kind}_{c}_total"] or 0)
            d = np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
            if min(n1, n2, n3, n4) > 0:
                y = n1 / (n1 + 2 * n2)
                d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 0.999, 1.999, 2.999])
            self.discount[c] = d
            self.back[c] = (d[1] * n1 + d[2] * n2 + d[3] * (n3 + n4 + more)) / max(self.total[c], 1)

    def evidence(self, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        n, whole = toxic + ordinary, sum(self.total.values())
        p, g = {}, 0.0
        for c, count in zip(CLASSES, (toxic, ordinary)):
            p[c] = (count - self.discount[c][np.minimum(count, 3)]) / self.total[c] + self.back[c] * n / whole
            g = g + 2 * count * np.log(np.maximum(count, 1) / np.maximum(n * self.total[c] / whole, 1e-300))
        g = np.where(g > 0, g, 0.0)
        return np.log(p["toxic"] / p["ordinary"]) * g / (g + CAUTION)


def _totals(counted: DataFrame, kind: str) -> dict:
    """Totals and counts of counts of the classes, and the number of codes and occurrences."""
    names = [f"{kind}_{c}_{k}" for c in CLASSES for k in ("total", 1, 2, 3, 4, "more")] + ["n", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in _rows(batch.select(["codes", "counts"])):
                codes, counts = _uncounted(codes, counts)
                out = []
                for own in counts[:2]:
                    out += [own.sum(), *[(own == k).sum() for k in (1, 2, 3, 4)], (own > 4).sum()]
                out += [len(codes), counts[2:].sum() if len(counts) > 2 else counts.sum()]
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in out], names=names)

    found = counted.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return found.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[f.split()[0] for f in PACKED.split(", ")])


def _parts(keys: np.ndarray, shards: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of ascending keys."""
    place = (keys >> U64(max(0, bits - 32))) * U64(shards) >> U64(min(32, bits))
    ends = np.searchsorted(place, np.arange(shards + 1, dtype=U64)).tolist()
    return ((k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a)


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in the bit table."""
    return ((keys >> U64(bits - TABLE)) if bits > TABLE else keys).astype(np.int64)


class Model:
    """What the lookups need: evidence of frequent expressions, shards and key bits."""

    def __init__(self, pairs: DataFrame, shard_keys: int = SHARD_KEYS, least_shards: int = 1):
        self.spark = pairs.sparkSession
        of_pairs = _totals(pairs, "pairs")
        self.some = bool(of_pairs["pairs_toxic_total"] and of_pairs["pairs_ordinary_total"])
        if not self.some:
            return
        words = stored(word_counts(pairs, max(self.spark.sparkContext.defaultParallelism, -(-of_pairs["n"] // shard_keys))), "words")
        of_words = _totals(words, "words")
        n = of_pairs["n"] + of_words["n"]
        self.bits = min(48, max(24, int(n).bit_length() + 16))
        self.shards = max(self.spark.sparkContext.defaultParallelism, -(-n // shard_keys), least_shards)
        self.tokens = of_pairs["tokens"]
        self.tables = [(pairs, Counts(of_pairs, "pairs"), True), (words, Counts(of_words, "words"), False)]

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, ascending, and evidence of the expressions with a large share of the occurrences; a bounded number."""
        keys, values = [np.zeros(0, U64)], [np.zeros(0, "<f4")]
        for table, counts, pairs in self.tables:
            for row in self._evidence(table, counts, pairs, True).toLocalIterator():
                keys.append(_of_ascending(row["keys"]))
                values.append(_of_planes(row["one"], "<f4"))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        return keys[order], values[order]

    def table(self) -> np.ndarray:
        """The bit table: whether the upper bits of some key that is not frequent are these."""
        bits_ = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys in batch.column("keys").to_pylist():
                    place = np.unique(_place(_of_ascending(keys), bits_))
                    first = int(place[0]) >> 3
                    bits = np.zeros((int(place[-1]) >> 3) + 1 - first << 3, dtype=bool)
                    bits[place - (first << 3)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([_planes(np.packbits(bits, bitorder="little"))], pa.binary())], names=["first", "bits"])

        out = np.zeros(1 << TABLE - 3, dtype=np.uint8)
        for row in self.rows().select("keys").mapInArrow(run, "first long, bits binary").toLocalIterator():
            bits = _of_planes(row["bits"], "u1")
            out[row["first"] : row["first"] + len(bits)] |= bits
        return out

    def rows(self) -> DataFrame:
        """Keys and evidence of all other counted expressions, packed by shard."""
        first, second = (self._evidence(*t, False) for t in self.tables)
        return first.union(second)

    def _evidence(self, table: DataFrame, counts: Counts, pairs: bool, frequent: bool) -> DataFrame:
        least, shards, bits = self.tokens / (1 << FREQUENT), self.shards, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for codes, own in _rows(batch.select(["codes", "counts"])):
                    codes, own = _uncounted(codes, own)
                    some = ((own[2] if len(own) > 2 else own.sum(axis=0)) >= least) == frequent
                    keys, value = keys_of(codes[some], pairs, bits), counts.evidence(own[0][some], own[1][some]).astype("<f4")
                    yield _packed([(k, 0, 0, _ascending(keys[a:b]), _planes(value[a:b]), b"") for k, a, b in _parts(keys, shards, bits)])

        return table.mapInArrow(run, PACKED)


def _text_rows(docs: DataFrame, model: Model, frequent) -> DataFrame:
    """The words and bigrams of (h, text) that are not frequent, packed by shard, and a row of hashes, numbers and sums for each slice."""
    shards, bits = model.shards, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        known, evidence, table = frequent.value
        for whole in W.slices(batches, "text", SLICE):
            for lo in range(0, whole.num_rows, 65_535):
                batch = whole.slice(lo, 65_535)
                codes, owners, base = [], [], 0
                for piece in W.slices(iter([batch]), "text"):
                    u, v, owner = bigrams(piece.column("text"))
                    codes.append(np.concatenate([keys_of(W.mix(v), False, bits), keys_of(W.mix((u << U64(32)) | v), True, bits)]))
                    owners.append(np.concatenate([owner, owner]) + base)
                    base += piece.num_rows
                keys = np.sort((np.concatenate(codes) << U64(16)) | np.concatenate(owners).astype(U64))
                owner, keys = (keys & U64(0xFFFF)).astype("<u2"), keys >> U64(16)
                n = np.bincount(owner, minlength=batch.num_rows).astype("<u4") // 2
                new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                own, times = keys[new], np.diff(new, append=len(keys))
                sums = np.zeros((2, 2 * batch.num_rows))
                if len(known):
                    found = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[found] == own
                    at = np.repeat(hit, times)
                    value = np.repeat(evidence[found[hit]], times[hit]).astype(np.float64)
                    cell = 2 * owner[at].astype(np.int64) + (keys[at] & U64(1)).astype(np.int64)
                    sums = np.stack([np.bincount(cell, w, 2 * batch.num_rows) for w in (value, np.maximum(value, 0) ** 4)])
                    own, times, owner = own[~hit], times[~hit], owner[~at]
                place = _place(own, bits)
                hit = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                owner, own, times = owner[np.repeat(hit, times)], own[hit], times[hit]
                ends = np.concatenate([[0], np.cumsum(times)])
                rows = [(nth % shards, 2, nth, batch.column("h").to_numpy().astype("<i8").tobytes(), n.tobytes(), sums.tobytes())]
                for k, a, b in _parts(own, shards, bits):
                    rows.append((k, 1, nth, _ascending(own[a:b]), _planes(times[a:b].astype("<u4")), _planes(owner[ends[a] : ends[b]])))
                yield _packed(rows)
                nth += 1

    return docs.mapInArrow(run, PACKED)


def _looked_up(rows: DataFrame) -> DataFrame:
    """(slice, docs, n, sums): four sums for each text of a slice that has counted expressions in a shard.

    Rows of hashes, numbers and sums go through as heads; ``n`` is null in all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, keys, values = None, [], np.zeros(0, U64), np.zeros(0, "<f4")
        for batch in batches:
            out = []
            for at, kind, slice_, own, one, other in _rows(batch):
                if at != shard:
                    shard, held, keys, values = at, [], np.zeros(0, U64), np.zeros(0, "<f4")
                if kind == 0:
                    held.append((_of_ascending(own), _of_planes(one, "<f4")))
                    continue
                if kind == 2:
                    out.append((slice_, own, one, other))
                    continue
                if held:
                    keys, values = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(keys)
                    keys, values, held = keys[order], values[order], []
                if not len(keys):
                    continue
                own = _of_ascending(own)
                found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                value = np.where(keys[found] == own, values[found], 0).astype(np.float64)
                docs = _of_planes(other, "<u2")
                times = _of_planes(one, "<u4")
                value, pair = np.repeat(value, times), np.repeat(own & U64(1), times).astype(np.int64)
                some = value != 0
                if not some.any():
                    continue
                who, at_doc = np.unique(docs[some], return_inverse=True)
                value, cell = value[some], 2 * at_doc + pair[some]
                sums = [np.bincount(cell, w, 2 * len(who)).astype("<f4") for w in (value, np.maximum(value, 0) ** 4)]
                out.append((slice_, _planes(np.diff(who.astype("<u2"), prepend=np.uint16(0))), None, _planes(np.stack(sums).ravel())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["slice", "docs", "n", "sums"])

    return rows.mapInArrow(run, "slice long, docs binary, n binary, sums binary")


def _summed(parts: DataFrame) -> DataFrame:
    """(h, SUMS): a row for each text, from sorted parts of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> pa.RecordBatch:
            h, n, sums = next((np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4"), np.frombuffer(x, "<f8")) for d, n, x in held if n is not None)
            sums = sums.reshape(2, len(h), 2).copy()
            for d, head, x in held:
                if head is None:
                    who = np.cumsum(_of_planes(d, "<u2"), dtype=np.int64)
                    sums[:, who] += _of_planes(x, "<f4").reshape(2, len(who), 2)
            n = np.maximum(n, 1).astype(float)
            values = (n, n, sums[0, :, 0], sums[1, :, 0], sums[0, :, 1], sums[1, :, 1])
            return pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, values)], names=["h", *SUMS])

        for batch in batches:
            for slice_, docs, n, sums in _rows(batch):
                if held and slice_ != at:
                    yield flush()
                    held = []
                at = slice_
                held.append((docs, n, sums))
        if held:
            yield flush()

    return parts.mapInArrow(run, "h long, " + ", ".join(f"{s} double" for s in SUMS))


def text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def evidence(docs: DataFrame, rows: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame | None:
    """(h, SUMS) of each different text of ``docs``; None if a class of the rows (id, text, toxic) has no words."""
    source = docs.select(text_hash(docs[text]).alias("h"), docs[text].cast("string").alias("text"))
    model = Model(stored(pair_counts(rows), "bigrams"), shard_keys, _shards(source, SHARD_BYTES))
    if not model.some:
        return None
    frequent = docs.sparkSession.sparkContext.broadcast((*model.frequent(), model.table()))
    dealt = model.rows().union(_text_rows(source, model, frequent)).repartition(model.shards, "shard").sortWithinPartitions("shard", "kind")
    found = _summed(_looked_up(dealt).repartition("slice").sortWithinPartitions("slice"))
    # copies of a text have the same sums
    sums = stored(found.groupBy("h").agg(*[F.max(s).alias(s) for s in SUMS]), "evidence")
    frequent.destroy()
    return sums


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", name: str = "toxicity", fit_rows: int = FIT_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` with a column of scores; all other columns are kept."""
    ship(docs.sparkSession)
    rows = labelled(docs, labels, key, text, label)
    sums = evidence(docs, rows.where(F.col("fold") != FIT), text, **options)
    if sums is None:
        return docs.withColumn(name, F.lit(0.0))
    sample = rows.where(F.col("fold") == FIT).select(F.xxhash64("id").alias("place"), "toxic", text_hash(F.col("text")).alias("h")).join(sums, "h")
    sample = sample.orderBy("place", "words").limit(fit_rows).toPandas()
    y = sample["toxic"].to_numpy(float)
    weights = np.array([-1.0, 0, 1, 0, 0, 1, 0])
    if 0 < y.sum() < len(y):
        weights = fitted(np.stack([np.ones(len(y)), *features({s: sample[s].to_numpy(float) for s in SUMS})], axis=1), y)
    z = sum((F.lit(float(w)) * f for w, f in zip(weights[1:], features({s: F.col(s) for s in SUMS}))), F.lit(float(weights[0])))
    h, score = f"h_{uuid.uuid4().hex}", f"score_{uuid.uuid4().hex}"
    by_text = sums.select(F.col("h").alias(h), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))).alias(score))
    return docs.withColumn(h, text_hash(docs[text])).join(by_text, h).withColumn(name, F.col(score)).drop(h, score)
