"""Token ids of whole texts in rANS-coded shards, written and read through Spark.

``write`` range-partitions the documents by id, encodes each text with the
tokenizers library, appends the end id and codes the ids of a shard's documents,
in ascending id order, as rANS segments of whole documents.  A shard is a Parquet
file whose rows are segments: (shard, segment, ids, lengths, n_tokens, payload);
Spark's writers commit it, so lost executors leave no half-written shard, and any
store that Spark reads can hold it.  ``read`` decodes the segments in parallel.

Null texts count as empty; an empty text has the end id alone.  A null id comes
first; repeated ids keep a row each, in the order of their texts.  An empty table
gives no segments and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import rans
from . import words as W
from .common import ship, text_and_id

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: letters for every version of Unicode, then marks or nothing: a byte-level pre-tokenizer parts these in two
_PLAIN = re.compile(r"([A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(0x100)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Uneven(Exception):
    """A cut stands beside another space."""


class _Known(dict):
    """Ids by unit; a unit that is new is learnt when it is asked for.

    Two generations: once the younger one is full it becomes the older one, from which
    units that are met again come back.
    """

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.old = learn, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.pop(unit, None)
        ids = self[unit] = self.learn(unit) if ids is None else ids
        return ids

    def make_room(self, most: int) -> None:
        if len(self) > most // 2:
            self.old = dict(self)
            self.clear()


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct word unit once.

    A byte-level pre-tokenizer never joins what stands before a single space
    between two non-space characters with what follows, so texts are cut there and
    the ids of the units are those of the whole text.  Texts that hold the string of
    an added token, and tokenizers of another kind, get whole texts.  About ``most`` units are remembered.

    What a pre-tokenizer does to units of plain letters and marks is known, so these go to the library's model at once.
    """

    def __init__(self, path: str, most: int = 800_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        #: added tokens are cut out of a text before anything else, so texts that hold one are encoded whole
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.model = self.tokenizer.model if self.by_unit and (spec.get("model") or {}).get("type") == "BPE" else None
        self.most = most
        #: a text's first unit, and later ones by the unit without the space before it
        self.first, self.later = _Known(lambda u: self._unit(u, "")), _Known(lambda u: self._unit(u, " "))
        #: letters without a space before them, and runs of marks
        self.bare, self.marks = _Known(lambda u: self._word(u, "")), _Known(self._one)
        self.feed = self._one("\n")

    def _encode(self, texts: list[str]) -> list[bytes]:
        # Spark runs a task on each core; threads of a task's own would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> bytes:
        return self._encode([text])[0]

    def _word(self, word: str, before: str) -> bytes:
        """The ids of plain letters, with a space before them or without."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(_BYTE_LETTERS[0x20] + shown if before else shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str, before: str) -> bytes:
        """The ids of a unit whose lines are plain letters and marks from the model, of any other from the whole tokenizer."""
        if before and (not unit or unit[0].isspace() or unit[-1].isspace()):
            raise _Uneven
        if self.model is None:
            return self._one(before + unit)
        head, *lines = unit.split("\n")
        plain = _PLAIN.fullmatch(head)
        rest = [_PLAIN.fullmatch(line) for line in lines]
        if plain is None or not all(rest):
            return self._one(before + unit)
        word, end = plain.groups()
        if end:
            # the word itself is likely to come, and other marks after it
            ids = (self.later if before else self.first)[word] + self.marks[end]
        else:
            ids = self._word(word, before)
        for word, end in (m.groups() for m in rest):
            ids += self.feed + self.bare[word] + (self.marks[end] if end else b"")
        return ids

    def _text(self, text: str) -> bytes:
        head, *words = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, words))
        except _Uneven:
            # a cut beside another space is no boundary: the text is cut again, between non-spaces only
            head, *words = _INNER_SPACE.split(text)
            return self.first[head] + b"".join(self._one(f" {w}") if w[-1].isspace() else self.later[w] for w in words)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_unit:
            return self._encode(texts)
        for known in (self.first, self.later, self.bare, self.marks):
            known.make_room(self.most)
        if not self.added:
            return list(map(self._text, texts))
        return [self._one(t) if any(a in t for a in self.added) else self._text(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and tokenizer file."""
    return UnitEncoder(path)


def segments(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", segment_tokens: int = 1 << 21) -> DataFrame:
    """(shard, segment, ids, lengths, n_tokens, payload): rANS segments of about ``segment_tokens`` ids."""
    ship(docs.sparkSession)
    source = text_and_id(docs, key, text)
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    kind = source.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, coded, held, number = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            lengths = [len(c) // 4 for c in coded]
            payload = rans.encode(np.frombuffer(b"".join(coded), dtype="<u4"))
            own = pa.concat_arrays([pa.array([], ids[0].type), *ids])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([payload], pa.binary()),
                ],
                names=schema.fieldNames(),
            )

        for batch in W.slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded += [c + end for c in encode(texts)]
            held += sum(map(len, islice(coded, len(coded) - len(texts), None))) // 4
            ids.append(batch.column("id"))
            if held >= segment_tokens:
                yield segment()
                ids, coded, held, number = [], [], 0, number + 1
        if ids:
            yield segment()

    return ordered.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> None:
    """Writes the segments of the documents as shards under ``path``."""
    segments(docs, tokenizer, end_id, **options).write.parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """(shard, segment, base): ids before each segment; one row for each shard meets in one task."""
    sizes = shards.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.select("shard", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own_base"))
    return own.join(per_shard, "shard").select("shard", "segment", (F.col("shard_base") + F.col("own_base")).alias("base"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, token_ids]) of every document, decoded from the shards.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    ship(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType
    fields = [
        T.StructField("shard", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("id", kind),
        T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    schema = T.StructType(fields + [T.StructField("token_ids", T.ArrayType(T.LongType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = rans.decode(row.column("payload")[0].as_py()).astype("<u4")
                lengths = row.column("lengths").flatten().to_numpy()
                ends = np.cumsum(lengths)
                if (int(ends[-1]) if len(ends) else 0) != len(ids):
                    raise ValueError("a segment's ids don't match its lengths")
                raw, n = memoryview(ids).cast("B"), len(lengths)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                columns = [
                    pa.array(np.full(n, row.column("shard")[0].as_py(), np.int32)),
                    pa.array(np.full(n, row.column("segment")[0].as_py(), np.int32)),
                    row.column("ids").flatten(),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = shards.select("shard", "segment", "ids", "lengths", "payload").mapInArrow(run, schema)
    placed = rows.join(_starts(shards.select("shard", "segment", "n_tokens")), ["shard", "segment"])
    return placed.select("id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)
