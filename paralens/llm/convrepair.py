"""Repair of conversations by the cheapest edits that give ``(system? (user assistant)+)?``.

Turns are reduced to light rows first: equal turns (turn, role, text) are one row with a
count, and a text is its SHA-256.  What was said before is found by grouping on role and
text, with partial aggregation.  Light rows are dealt by ranges of (conversation, turn,
role, hash), so a long conversation lies in several chunks.

The edits come from a dynamic programme over (row, grammar state), run backward: the
cost to go from each state.  A chunk's rows act on the costs behind them as a matrix over
(min, +), so the costs at the chunk borders follow from one small matrix a chunk (collected:
16 numbers for each partition); then each chunk is solved on its own.  Each row gets the
ASCII-least among the cost-tight edits for every state it may be met in.

A forward walk follows these choices from the start state, row by row with the texts, and
feeds the rebuilt turns to SHA-256.  The hash reads a conversation's text in its order, so
one task streams it; it holds one turn at a time.

Null ids are a conversation of their own.  Null turns come first.  A null role or text is
one space.  Turns of one number are taken by role, then by the hash of the text; repeated
rows are duplicates.  A role that is empty or starts with another letter than s, u or a
can't be kept.  An empty table gives no rows.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

INF = 1 << 50
#: grammar states: start, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: by state: the state after the only role that an inserted or renamed turn can have there
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: by state: the state after a kept role with this initial
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: costs of the edits, and of a truncated turn that stays
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: by state: the inserts that end a conversation
TAIL = ("", "II", "I", "")
END = (0, 2 * INSERT, INSERT, 0)
SPACES = " \t\n\x0b\x0c\r"


def with_inserts(base: list[int]) -> list[int]:
    """Costs to go from each state if turns may be inserted first."""
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    return [min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant]


def step(initial: str, free: bool, cut_off: bool, forced: int, after: list[int]) -> tuple[list[int], list[str] | None]:
    """Costs to go before a row, and its edits by state, from the costs after it.

    ``free``: the first of the row's equal turns may stay; ``forced`` more have to go.
    """
    after = [c + DELETE * forced for c in after]
    if not free:
        return after, None
    extra = TRUNCATED if cut_off else 0
    drop = [DELETE + c for c in after]
    keep = [extra + after[KEPT[q][initial]] if initial in KEPT[q] else INF for q in range(4)]
    name = [RENAME + extra + after[NEXT[q]] for q in range(4)]
    base = [min(x) for x in zip(drop, keep, name)]
    costs = with_inserts(base)
    edits = []
    for q in range(4):
        # D before I before K before R
        way, at = "", q
        while drop[at] != costs[at] and costs[at] == INSERT + costs[NEXT[at]]:
            way, at = way + "I", NEXT[at]
        edits.append(way + ("D" if drop[at] == costs[at] else "K" if keep[at] == costs[at] else "R"))
    return costs, edits


def _light(turns: DataFrame) -> DataFrame:
    """A row for each distinct (k, turn, role, hash): how often it is there, and whether the first of them is new."""
    bare = F.rtrim("text", F.lit(SPACES))
    last = F.substring(bare, -1, 1)
    seen = turns.select("k", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), "times", (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"))
    rows = seen.groupBy("k", "turn", "role", "h", "blank", "cut_off").agg(F.sum("times").alias("n"))
    # a null turn is the smallest; only what is said at several turns needs a first one
    first = rows.groupBy("k", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("m")).where("m > 1").select(F.struct("k", "role", "h").alias("said"), F.col("first.turn").alias("at"))
    met = rows.join(first, (rows["k"].eqNullSafe(first["said.k"])) & (rows["role"] == first["said.role"]) & (rows["h"] == first["said.h"]), "left")
    new = F.col("said").isNull() | F.col("turn").eqNullSafe(F.col("at"))
    return met.select("k", "turn", "role", "h", "n", "blank", "cut_off", new.alias("new"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """The rows of each conversation of a chunk, in order."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[0]["k"] != row["k"]:
                yield own[0]["k"], own
                own = []
            own.append(row)
    if own:
        yield own[0]["k"], own


def _backward(rows: list[dict], after: list[int]) -> Iterator[tuple[dict, list[int], list[str] | None]]:
    """The rows from the last to the first, each with the costs before it and its edits by state."""
    for row in reversed(rows):
        free = row["new"] and not row["blank"]
        after, edits = step(row["role"][:1], free, row["cut_off"], row["n"] - free, after)
        yield row, after, edits


def _borders(ordered: DataFrame) -> dict[int, list[int]]:
    """By chunk: the costs to go behind its last conversation, where that goes on in a later chunk.

    A chunk sends its first conversation's matrix to the driver: a bounded row for each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, matrix, n = None, None, [], 0
        for key, rows in _pieces(batches):
            last, n = key, n + 1
            if n == 1:
                first = key
                for q in range(4):
                    unit = [INF] * 4
                    unit[q] = 0
                    for _, unit, _ in _backward(rows, unit):
                        pass
                    matrix += [min(c, INF) for c in unit]
        if n:
            chunk = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "first": repr(first), "last": repr(last), "n": n, "matrix": matrix}], schema=kind)

    kind = pa.schema([("chunk", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    chunks = sorted(ordered.mapInArrow(run, "chunk int, first string, last string, n long, matrix array<bigint>").collect(), key=lambda r: r["chunk"])
    behind: dict[int, list[int]] = {}
    later, exit_ = None, list(END)
    for own in reversed(chunks):
        goes_on = later is not None and later["first"] == own["last"]
        if goes_on:
            # costs before the later chunk's part, from the costs behind that part
            after = exit_ if later["n"] == 1 else list(END)
            exit_ = [min(min(later["matrix"][4 * q + s] + after[q] for q in range(4)), INF) for s in range(4)]
            behind[own["chunk"]] = exit_
        else:
            exit_ = list(END)
        later = own
    return behind


def _decided(ordered: DataFrame) -> DataFrame:
    """The light rows with their edits for each state they may be met in, comma-joined (null: all have to go)."""
    behind = _borders(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = behind.get(TaskContext.get().partitionId())
        held, n = [], 0
        pieces = _pieces(batches)
        now = next(pieces, None)
        while now is not None:
            later = next(pieces, None)
            after = border if later is None and border is not None else list(END)
            done = [row | {"edits": edits and ",".join(edits)} for row, _, edits in _backward(now[1], after)]
            held += reversed(done)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
            now = later
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = [*ordered.dtypes, ("edits", "string")]
    kind = pa.schema([(c, types[t]) for c, t in columns])
    return ordered.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns))


class _Walk:
    """The forward walk through one conversation: counts, audit and hash, one turn at a time."""

    def __init__(self, key):
        self.key, self.state, self.cost, self.audit = key, START, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.turn = None
        self.initial: str | None = None
        self.hash, self.any = hashlib.sha256(), False
        #: the role under which the text that comes next goes on
        self.wanted: str | None = None

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + role + ":" + text).encode())
        self.any = True

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.cost += INSERT
        self.write(ROLE[self.state], "")

    def row(self, turn, role: str, n: int, blank: bool, cut_off: bool, new: bool, edits: str | None) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += (n - 1) * (2 * initial not in LEGAL)
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
        if blank:
            self.blank += n
        else:
            self.duplicate += n - new
            self.truncated += cut_off and new
        forced = n
        if edits is not None:
            forced -= 1
            way = edits.split(",")[self.state]
            self.audit.append(way)
            for letter in way:
                if letter == "I":
                    self.insert()
                elif letter == "D":
                    self.cost += DELETE
                else:
                    self.cost += (TRUNCATED if cut_off else 0) + (RENAME if letter == "R" else 0)
                    self.state = KEPT[self.state][initial] if letter == "K" else NEXT[self.state]
                    self.wanted = role if letter == "K" else ROLE[self.state]
        self.audit.append("D" * forced)
        self.cost += DELETE * forced

    def text(self, text: str) -> None:
        if self.wanted is not None:
            self.write(self.wanted, text)
            self.wanted = None

    def done(self) -> dict:
        for letter in TAIL[self.state]:
            self.audit.append(letter)
            self.insert()
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        counts = {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return {"k": self.key, "gaps": gaps, **counts, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _walked(decided: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation; light rows and texts meet in one order, in one shuffle of the texts."""
    texts = turns.where(F.rtrim("text", F.lit(SPACES)) != "").select("k", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.lit(True).alias("said"), "text")
    both = decided.withColumn("said", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    order = ["k", "turn", "role", "h", "said"]
    key = decided.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, out = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("k", "said", "text", "turn", "role", "n", "blank", "cut_off", "new", "edits")]
            for k, said, text, *light in zip(*columns):
                if walk is None or walk.key != k:
                    if walk is not None:
                        out.append(walk.done())
                    walk = _Walk(k)
                if said:
                    walk.text(text)
                else:
                    walk.row(*light)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if walk is not None:
            out.append(walk.done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = pa.schema([("k", pa.string() if key == "string" else pa.int64()), *((c, pa.int64()) for c in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return both.repartition("k").sortWithinPartitions(*order).mapInArrow(run, f"k {key}, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string")


def _plain(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    def space(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    k = turns[key] if dict(turns.dtypes)[key] == "string" else turns[key].cast("long")
    return turns.select(k.alias("k"), turns[turn].cast("long").alias("turn"), space(turns[role]).alias("role"), space(turns[text]).alias("text"), F.lit(1).cast("long").alias("times"))


def damaged(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(k, turn, role, text, times): the turns with repeatable damage, by crc32 of ``key:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it (``times`` is 2), 4 gives it to the user.  Nulls are one space.
    """
    plain = _plain(turns, key, turn, role, text)
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("k", "turn")])
    hit = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    return (
        plain.withColumn("hit", hit)
        .where("hit <> 0")
        .select(
            "k",
            "turn",
            F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("times"),
        )
    )


def repaired(turns: DataFrame, plain: bool = False, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(k, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    ``plain`` turns have the columns of damaged() already.
    """
    ship(turns.sparkSession)
    rows = turns if plain else _plain(turns, key, turn, role, text)
    order = ["k", "turn", "role", "h"]
    ordered = cut(_light(rows).repartitionByRange(*order).sortWithinPartitions(*order))
    return _walked(_decided(ordered), rows)


def of_damaged(turns: DataFrame, key: str = "conv_id", **columns) -> DataFrame:
    """repaired() of damaged() turns, with a row of zeros for each conversation that lost all its turns."""
    found = repaired(damaged(turns, key, **columns), plain=True)
    ids = turns.select(turns[key].alias("id")).distinct()
    all_ = ids.join(found, ids["id"].eqNullSafe(found["k"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select("id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
