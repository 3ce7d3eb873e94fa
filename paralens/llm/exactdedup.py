"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Senders.  A task cuts its rows into pieces of one file.  A piece sorts the
   fingerprints of its texts, cuts the sorted list at the borders of the owners'
   ranges and codes the gaps of each part with a Golomb code whose divisor is a power
   of two.  Fingerprints have log2(rows) + ``spare`` bits, so a part costs about
   log2(pieces) + ``spare`` + 1.5 bits a text.
2. Owners.  An owner gets the parts of its range, finds the fingerprints that two
   pieces or more have, and answers each part with a bitmap.
3. Suspects.  Each answer, and what a piece knew to be repeated within itself, marks
   rows of the sender's file; a row is named by its file and its place there, however
   often and wherever the file is read.  The marks (one bit a row) are broadcast to a
   second scan while they are at most ``broadcast_bytes``; more are dealt with file by
   file, in several scans of disjoint files.
4. Verification.  Only the texts of suspects are shuffled.  They are grouped by their
   bytes, with partial aggregation before the shuffle, so a group of any size is one row
   a task.  Falsely suspected texts come out as groups of one.

Null texts count as empty.  Of equal texts the row with the largest id stays; null ids
are smaller than all others, and of rows that share the largest id one stays.  Repeated
rows are copies like any other.  An empty table gives no rows.  Other columns neither
clash nor matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, ship, stored, whole_groups

U64 = np.uint64
#: rows of a file that share one bitmap of 64 words
SLICE = 4096
#: bytes that a bitmap takes in a broadcast, beside its file's name
MARK_BYTES = 8 * 64 + 128


def golomb(values: np.ndarray, base: int, span: int) -> tuple[int, bytes, bytes]:
    """(shift, quotients, remainders) of ascending distinct values within base .. base + span - 1.

    Gaps are divided by 2**shift; quotients are unary, remainders have ``shift`` bits.
    """
    n = len(values)
    shift = max(0, (span // max(1, n)).bit_length() - 1)
    gaps = np.diff(values.astype(np.int64) - base, prepend=-1) - 1
    ones = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[ones] = 1
    rest = (gaps[:, None] >> np.arange(shift)) & 1
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def ungolomb(n: int, base: int, shift: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The n values that golomb() coded."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1) << shift
    if shift:
        rest = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * shift].reshape(n, shift)
        gaps += rest.astype(np.int64) @ (np.int64(1) << np.arange(shift))
    return np.cumsum(gaps + 1) - 1 + base


def _senders(rows: DataFrame, bits: int, owner_bits: int, piece_rows: int) -> DataFrame:
    """One row for each piece and owner: the coded fingerprints, and the places of their rows in the file."""
    span = 1 << (bits - owner_bits)

    def parts(path: str, place: np.ndarray, h: np.ndarray) -> Iterator[dict]:
        order = np.argsort(h, kind="stable")
        h, place, start = h[order], place[order], int(place.min())
        first = np.flatnonzero(np.diff(h, prepend=h[:1] + 1))
        times = np.diff(first, append=len(h))
        values = h[first]
        cuts = np.searchsorted(values, np.arange((1 << owner_bits) + 1) * span)
        for owner in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[owner], cuts[owner + 1]
            shift, quotients, remainders = golomb(values[lo:hi], int(owner) * span, span)
            rows = slice(first[lo], first[hi - 1] + times[hi - 1])
            local = np.repeat(times[lo:hi] > 1, times[lo:hi])
            yield {
                "path": path,
                "start": start,
                "owner": int(owner),
                "n": int(hi - lo),
                "shift": shift,
                "quotients": quotients,
                "remainders": remainders,
                "places": (place[first[lo:hi]] - start).astype("<u4").tobytes(),
                "local": (place[rows][local] - start).astype("<u4").tobytes(),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        name, n = None, 0

        def done() -> Iterator[pa.RecordBatch]:
            out = list(parts(name, *(np.concatenate(x) for x in zip(*held))))
            yield pa.RecordBatch.from_pylist(out, schema=kind)

        for batch in batches:
            paths = batch.column("path").dictionary_encode()
            codes = paths.indices.to_numpy()
            place = batch.column("place").to_numpy()
            h = batch.column("h").to_numpy().view(U64) >> U64(64 - bits)
            at = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(at, at[1:]):
                if lo == hi:
                    continue
                if held and (paths.dictionary[int(codes[lo])].as_py() != name or n + hi - lo > piece_rows):
                    yield from done()
                    held, n = [], 0
                name = paths.dictionary[int(codes[lo])].as_py()
                held.append((place[lo:hi], h[lo:hi].astype(np.int64)))
                n += hi - lo
        if held:
            yield from done()

    kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), *((c, pa.binary()) for c in ("quotients", "remainders", "places", "local"))])
    return rows.mapInArrow(run, "path string, start long, owner int, n int, shift int, quotients binary, remainders binary, places binary, local binary")


def _owners(sent: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """(path, start, owner, bitmap) for each part that holds a fingerprint of another piece."""
    span = 1 << (bits - owner_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["owner"]):
            owners = group.column("owner").to_numpy()
            marks = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for lo, hi in zip(marks, marks[1:]):
                part = group.slice(lo, hi - lo)
                sizes = part.column("n").to_numpy()
                lists = zip(sizes.tolist(), part.column("shift").to_pylist(), part.column("quotients").to_pylist(), part.column("remainders").to_pylist())
                values = np.concatenate([ungolomb(n, int(owners[lo]) * span, *x) for n, *x in lists])
                _, which, times = np.unique(values, return_inverse=True, return_counts=True)
                flags = np.split(times[which] > 1, np.cumsum(sizes)[:-1])
                some = [k for k, f in enumerate(flags) if f.any()]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(some, pa.int64())) for c in ("path", "start", "owner")), pa.array([np.packbits(flags[k]).tobytes() for k in some], pa.binary())], names=["path", "start", "owner", "bitmap"])

    coded = sent.select("owner", "path", "start", "n", "shift", "quotients", "remainders")
    return coded.repartition("owner").sortWithinPartitions("owner").mapInArrow(run, "path string, start long, owner int, bitmap binary")


def _marks(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """(path, slice, words): a bit for each suspected row of a run of SLICE rows of a file."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, bytes]] = []
            for row in batch.to_pylist():
                at = np.frombuffer(row["places"], "<u4")
                known = np.unpackbits(np.frombuffer(row["bitmap"] or b"", np.uint8))[: len(at)].astype(bool)
                at = np.concatenate([at[: len(known)][known], np.frombuffer(row["local"], "<u4")]).astype(np.int64) + row["start"]
                at.sort()
                cuts = [0, *(np.flatnonzero(np.diff(at // SLICE)) + 1).tolist(), len(at)]
                out += [(row["path"], int(at[lo]) // SLICE, (at[lo:hi] % SLICE).astype("<u2").tobytes()) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "slice", "at"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["path", "slice"]):
            paths, slices = group.column("path").to_pylist(), group.column("slice").to_pylist()
            words: dict[tuple[str, int], np.ndarray] = {}
            for path, slice_, at in zip(paths, slices, group.column("at").to_pylist()):
                at = np.frombuffer(at, "<u2").astype(np.int64)
                np.bitwise_or.at(words.setdefault((path, slice_), np.zeros(SLICE // 64, U64)), at >> 6, U64(1) << (at & 63).astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in words]), pa.array([k[1] for k in words], pa.int64()), pa.array([w.view(np.int64) for w in words.values()], pa.list_(pa.int64()))], names=["path", "slice", "words"])

    asked = sent.select("path", "start", "owner", "places", "local").join(answers, ["path", "start", "owner"], "left")
    found = asked.where("bitmap is not null or length(local) > 0").mapInArrow(places, "path string, slice long, at binary")
    return found.repartition("path", "slice").sortWithinPartitions("path", "slice").mapInArrow(merged, "path string, slice long, words array<bigint>")


def _scans(marks: DataFrame, most: int) -> list[tuple[list[str], bool]]:
    """The files of each further scan, and whether their marks may be broadcast; all other files go into the first, which is [] here."""
    sizes = marks.groupBy("path").agg((F.count("*") * (F.length("path") + MARK_BYTES)).alias("bytes")).orderBy(F.desc("bytes"), "path").collect()
    scans: list[tuple[list[str], int]] = [([], 0)]
    for path, size in sizes:
        if scans[-1][1] and scans[-1][1] + size > most:
            scans.append(([], 0))
        scans[-1] = ([*scans[-1][0], path], scans[-1][1] + size)
    return [(files, size <= most) for files, size in scans]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, spare: int = 8, owner_rows: int = 1 << 21, piece_rows: int = 1 << 18, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256, row) for every row of ``docs``.

    ``row`` is a struct of the columns ``carry``, null if there are none.  One text in
    2**spare is suspected without a copy.  An owner gets at most about ``owner_rows``
    fingerprints, a piece has at most about ``piece_rows`` rows.
    """
    spark = docs.sparkSession
    ship(spark)
    row = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    base = [docs[key].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), row.alias("row")]
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place")]
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of its own")
        rows = docs.select(*base, *place)
    except AnalysisException:  # not read from Parquet files
        rows = stored(docs.select(*base), "exact-texts").select("id", "text", "row", *place)
    n = rows.count()
    bits = min(60, n.bit_length() + spare)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()
    owner_bits = max((n // owner_rows).bit_length(), min(parallel, (n >> 12).bit_length()))
    sent = stored(_senders(rows.select("path", "place", F.xxhash64("text").alias("h")), bits, owner_bits, piece_rows), "exact-fingerprints")
    marks = stored(_marks(sent, _owners(sent, bits, owner_bits)), "exact-suspects")

    path = f"{shared(spark)}/exact-judged-{uuid.uuid4().hex}"
    scans = _scans(marks, broadcast_bytes)
    for k, (files, small) in enumerate(scans):
        own = marks.where(F.col("path").isin(files)) if k else marks
        part = rows.where(F.col("path").isin(files)) if k else rows
        if not k and len(scans) > 1:
            others = [f for x, _ in scans[1:] for f in x]
            own, part = own.where(~F.col("path").isin(others)), part.where(~F.col("path").isin(others))
        own = own.withColumnsRenamed({"path": "file"})
        beside = (part["path"] == own["file"]) & (F.shiftright(part["place"], SLICE.bit_length() - 1) == own["slice"])
        bit = F.getbit(F.get("words", F.shiftright(F.col("place").bitwiseAND(SLICE - 1), 6).cast("int")), F.col("place").bitwiseAND(63).cast("int"))
        met = part.join(F.broadcast(own) if small else own, beside, "left").withColumn("suspect", F.coalesce(bit, F.lit(0)) == 1)
        judged = met.select(F.monotonically_increasing_id().alias("at"), F.lit(k).alias("scan"), "id", "row", F.sha2("text", 256).alias("sha256"), "suspect", F.when(F.col("suspect"), F.col("text")).alias("text"))
        judged.write.mode("append").parquet(path)
    read = spark.read.schema(judged.schema).parquet(path)

    equal = read.where("suspect").groupBy("text").agg(F.max(F.struct("id", "scan", "at")).alias("top"), F.count("*").alias("group_size"), F.first("sha256").alias("sha256"))
    verified = read.where("suspect").drop("text").join(equal.select("top", "group_size", "sha256"), "sha256")
    alone = read.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256", "row")
    return alone.unionByName(verified.select("id", F.col("top.id").alias("keep_id"), "group_size", ((F.col("at") == F.col("top.at")) & (F.col("scan") == F.col("top.scan"))).alias("kept"), "sha256", "row"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    return groups(docs, key, text, carry=docs.columns, **options).where("kept").select("row.*")


def sql() -> str:
    """The same decisions in SQL, for ``documents``."""
    return """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
