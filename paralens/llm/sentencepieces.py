"""SentencePiece models run by the tokenizers library.

``Model`` parses the model's protobuf: pieces with scores and types, the model type,
byte fallback, and the normaliser's settings.  ``tokenizer`` rebuilds it: the
normaliser (character map, removal of extra spaces, dummy prefix, spaces as the
metaspace marker), a Unigram model with the scores or a BPE model whose merges
follow them, and the decoder.

Where no piece has a marker after another character, a text can be cut before each
run of markers: the ids of the whole are those of the units one after the other.
Then each distinct unit of a batch is encoded once, in multithreaded batches, and
its ids are compared with those of the sentencepiece library (``parity``).  Other
models get whole texts.  A BPE unit in which several spaces meet is merged here,
because pieces of equal score are merged leftmost first, which ranked merges cannot
say.

Null texts count as empty and have no ids.  Repeated rows keep a row each; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import ship

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append(piece)
                out.scores.append(score)
                out.types.append(kind)
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.byte_fallback, out.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.remove_extra, out.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")
        return out

    def plain(self) -> dict[str, int]:
        """Ids of the pieces that text can match."""
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best scores first."""
        ids = self.plain()
        found = []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in ids and right in ids:
                    found.append((-self.scores[i], i, ids[left], ids[right], left, right))
        return [f[4:] for f in sorted(found)]

    def by_unit(self) -> bool:
        """Whether no piece has a marker after another character."""
        return self.escape and MARK in self.plain() and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.plain())

    def model(self):
        from tokenizers import models

        if self.kind == UNIGRAM:
            # pieces that text cannot match keep their ids but get scores that never win
            low = min(self.scores) - 1e6
            vocab = [(p, s if t in (NORMAL, USER) else low) for p, s, t in zip(self.pieces, self.scores, self.types)]
            return models.Unigram(vocab, self.unk_id, self.byte_fallback)
        vocab = {p: i for i, p in enumerate(self.pieces)}
        return models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback)

    def normalizer(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def decoder(self):
        from tokenizers import decoders

        return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix])

    def tokenizer(self, with_normalizer: bool = True):
        """The model in the tokenizers library."""
        from tokenizers import Tokenizer

        out = Tokenizer(self.model())
        if with_normalizer:
            out.normalizer = self.normalizer()
        out.decoder = self.decoder()
        return out


class Merger:
    """BPE by scores, the leftmost of equal pairs first; for units that ranked merges can't settle."""

    def __init__(self, model: Model):
        self.ids = model.plain()
        self.scores = model.scores
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE} if model.byte_fallback else {}
        self.unk = model.unk_id

    def __call__(self, unit: str) -> list[int]:
        parts: list[str | None] = list(unit)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (i := self.ids.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, both))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        last_unknown = False
        for part in parts:
            if part is None:
                continue
            if part in self.ids:
                out.append(self.ids[part])
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode()]
            elif not last_unknown:
                out.append(self.unk)
            last_unknown = part not in self.ids and not self.bytes
        return out


_SPACES = re.compile(" *[^ ]+| +")


class Codec:
    """Encodes and decodes batches of texts with one model."""

    def __init__(self, data: bytes, parity: bool = True, most: int = 300_000, kept: int = 50_000, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.parse(data)
        self.by_unit = self.model.by_unit()
        self.bare = self.model.tokenizer(with_normalizer=False)
        self.merge = Merger(self.model) if self.model.kind == BPE else None
        normal = self.model
        self.plain = not normal.charsmap and not normal.remove_extra and normal.dummy_prefix
        self.clean = normal.normalizer() if not self.plain else None
        self.most, self.kept = most, kept
        self.units: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.check = None
        if parity:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=data)

    @cached_property
    def whole(self):
        """The tokenizer of whole texts, for models that aren't applied by unit."""
        return self.model.tokenizer()

    def forget(self) -> None:
        """Lets all units but the first ones go; frequent ones are met first."""
        if len(self.units) > self.kept:
            self.units = dict(islice(self.units.items(), self.kept))
            self.differing.intersection_update(self.units)

    def _cut(self, text: str) -> list[str]:
        """The text's units without their first marker (of which each has at least one)."""
        if not self.plain:
            text = self.clean.normalize_str(text).replace(MARK, " ")
            if text[:1] != " ":
                return [text] if text else []
            text = text[1:]
        elif MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            units = _SPACES.findall(text)
            return [units[0], *[u[1:] for u in units[1:]]] if units else []
        return text.split(" ") if text else []

    def _learn(self, units: list[str]) -> None:
        for lo in range(0, len(units), 20_000):
            some = units[lo : lo + 20_000]
            marked = [MARK + u.replace(" ", MARK) for u in some]
            ids = [e.ids for e in self.bare.encode_batch_fast(marked, add_special_tokens=False)]
            if self.merge:
                for k, unit in enumerate(some):
                    if unit[:1] == " " or not unit:
                        ids[k] = self.merge(marked[k])
            if self.check is not None and self.plain:
                for unit, own, other in zip(some, ids, self.check.encode(some, num_threads=1)):
                    # alone, an empty unit has no dummy prefix
                    if own != other and unit:
                        self.differing.add(unit)
            self.units.update(zip(some, (np.array(i, dtype="<u4").tobytes() for i in ids)))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and whether they agree with the sentencepiece library."""
        # another encoder of the same worker may have turned threads off
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if not self.by_unit:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            same = [True] * len(texts) if self.check is None else [a == b for a, b in zip(ids, self.check.encode(texts, num_threads=1))]
            return [np.array(i, dtype="<u4").tobytes() for i in ids], same
        cut = [self._cut(t) for t in texts]
        if len(self.units) > self.most:
            self.forget()
        self._learn(list(set().union(*cut).difference(self.units)))
        coded = [b"".join(map(self.units.__getitem__, units)) for units in cut]
        if self.check is not None and not self.plain:
            return coded, [np.frombuffer(c, "<u4").tolist() == o for c, o in zip(coded, self.check.encode(texts, num_threads=1))]
        same = [self.differing.isdisjoint(units) for units in cut] if self.differing else [True] * len(cut)
        if self.check is not None:
            # where cutting and joining is more than a split at single spaces, the whole text is compared
            uneven = [k for k, t in enumerate(texts) if "  " in t or MARK in t or t[:1] == " " or t[-1:] == " "]
            for k, other in zip(uneven, self.check.encode([texts[k] for k in uneven], num_threads=1) if uneven else ()):
                same[k] = np.frombuffer(coded[k], "<u4").tolist() == other
        return coded, same

    def decode(self, coded: list[bytes]) -> list[str]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        return self.bare.decode_batch([np.frombuffer(c, "<u4").tolist() for c in coded], skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token_ids, n_tokens, ids_crc32, parity, lossless, decoded) of every text.

    ``parity``: the sentencepiece library gives the same ids.  ``lossless``: decoding
    the ids gives the text back; where it doesn't, ``decoded`` has what it gives.
    ``model`` is a file that every executor can open (part of its installation).
    """
    ship(docs.sparkSession)
    source = docs.select(docs[key].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("parity", T.BooleanType()),
            T.StructField("lossless", T.BooleanType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    return source.mapInArrow(partial(_encoded, model=model, names=schema.fieldNames()), schema)


def _encoded(batches: Iterator[pa.RecordBatch], model: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    codec = _codec(model)
    try:
        for batch in W.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            coded, parity = codec.encode(texts)
            back = codec.decode(coded)
            lossless = [a == b for a, b in zip(texts, back)]
            ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"))),
                    pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                    pa.array(parity),
                    pa.array(lossless),
                    pa.array([None if ok else b for ok, b in zip(lossless, back)], pa.string()),
                ],
                names=names,
            )
    finally:
        # the worker lives on, beside those of other stages
        codec.forget()
        W.give_back()
