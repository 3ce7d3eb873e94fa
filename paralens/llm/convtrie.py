"""Prefix trie of conversations by a Patricia construction.

A turn is a token of 16 bytes (its SHA-256, cut) and a conversation the row of its tokens;
texts go no further than that.  Equal conversations are counted first, with partial
aggregation, so copies are one content.  Contents are dealt by ranges of their tokens and
sorted; a chunk builds its Patricia tree from the common prefixes of neighbours: a point
for every branch, end and leaf, none for turns with a single way on.  Members, leaves and
saved bytes add up on these points; the unary nodes of an edge are written out last, from
sums along the edge counted from its lower end.

The prefixes that a chunk shares with the chunks beside it, at most one path at each
border, are written as partial sums and added up by prefix: every sum is cut so that a
chunk counts only what is new in it.  The lengths of the common prefixes at the borders
are collected: two keys for each partition.

Null roles and texts are empty, null turns come first, turns of one number are taken by
their tokens.  Rows without a conversation id belong to none and are left out.  Repeated
rows are turns of their own.  An empty table gives no rows.  A conversation travels as 24
bytes a turn, whole.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, stored

TOKEN = 16
NOBODY = hashlib.sha256().hexdigest()
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, up binary"


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, tokens, sizes): each conversation's turns in order, as tokens and bytes of text."""
    r, t = (F.coalesce(turns[x].cast("string"), F.lit("")) for x in (role, text))
    token = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * TOKEN)
    rows = turns.where(turns[key].isNotNull()).select(turns[key].cast("long").alias("c"), F.struct(turns[turn].cast("long").alias("turn"), token.alias("token"), F.octet_length(t).cast("long").alias("size")).alias("x"))
    listed = rows.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("c", F.col("xs.token").alias("tokens"), F.col("xs.size").alias("sizes"))


def rebuilt(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The conversations with their first h turns taken from conversation c - c % every; h = crc32(c) % most."""
    own = seqs.withColumn("p", F.col("c") - F.pmod("c", F.lit(every))).withColumn("h", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most)).cast("int"))
    heads = seqs.where(F.pmod("c", F.lit(every)) == 0).select(F.col("c").alias("p"), *[F.slice(x, 1, most - 1).alias(f"head_{x}") for x in ("tokens", "sizes")])

    def spliced(x: str):
        head = F.coalesce(F.slice(f"head_{x}", F.lit(1), F.col("h")), F.slice(x, 1, 0))
        return F.concat(head, F.slice(x, F.col("h") + 1, F.size(x))).alias(x)

    return own.join(heads, "p", "left").select("c", spliced("tokens"), spliced("sizes"))


def contents(seqs: DataFrame) -> DataFrame:
    """(key, sizes, n, low, ends): each distinct conversation, its members, the smallest and the hash of their ids."""
    ship(seqs.sparkSession)
    packed = seqs.select("c", F.unhex(F.array_join("tokens", "")).alias("key"), "sizes").withColumn("h", F.unhex(F.sha2("key", 256)))
    distinct = packed.select("h", "key", "sizes").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for h, c in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist()):
                if now is None or now[0] != h:
                    if now is not None:
                        out.append((*now[:3], now[3].hexdigest()))
                    now = [h, 1, c, hashlib.sha256(str(c).encode())]
                else:
                    now[1] += 1
                    now[3].update(f",{c}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["h", "n", "low", "ends"])
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*now[:3], now[3].hexdigest()), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["h", "n", "low", "ends"])

    # ids alone are dealt by content: the hash reads them in their order
    members = packed.select("h", "c").repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, "h binary, n long, low long, ends string")
    return distinct.join(members, "h").select("key", "sizes", "n", "low", "ends")


def common_prefix(a: bytes, b: bytes) -> int:
    """Tokens at the start of both."""
    most = min(len(a), len(b)) // TOKEN
    low = 0
    while low < most:
        half = (low + most + 1) // 2
        if a[TOKEN * low : TOKEN * half] == b[TOKEN * low : TOKEN * half]:
            low = half
        else:
            most = half - 1
    return low


class Patricia:
    """The compressed tree of a sorted list of distinct keys.

    Arrays over its points, the root first: depth, parent, lo and hi (the keys below it),
    rep (a key below it), low, n, children, leaves, end (the key that ends there, or -1) and
    below: the saved bytes of all nodes under it.  ``before`` and ``after``: tokens that the
    first key shares with the key before all, and the last with the key after all (-1: none).
    """

    def __init__(self, keys: list[bytes], sizes: list[np.ndarray], n: list[int], low: list[int], before: int, after: int):
        self.keys, self.before, self.after, self.last = keys, before, after, len(keys) - 1
        length = np.array([len(s) for s in sizes], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(length + 1)])
        #: bytes of a key's first d texts are at offset + d, counted from the key's own start
        self.bytes = np.concatenate([np.concatenate([[0], np.cumsum(s)]) for s in sizes]).astype(np.int64)
        self.members = np.concatenate([[0], np.cumsum(n)])
        self.depth, self.parent, self.lo, self.hi, self.rep = [0], [-1], [0], [self.last], [0]
        self.low, self.children, self.leaves, self.end, self.below = [low[0]], [0], [0], [-1], [0]
        open_ = [0]
        for i, key in enumerate(keys):
            shared = common_prefix(keys[i - 1], key) if i else 0
            while self.depth[open_[-1]] > shared:
                point = open_.pop()
                if self.depth[open_[-1]] < shared:
                    open_.append(self._point(shared, self.lo[point], self.rep[point], self.low[point]))
                self._close(point, open_[-1], i - 1)
            if length[i] > self.depth[open_[-1]]:
                open_.append(self._point(int(length[i]), i, i, low[i]))
            self.end[open_[-1]] = i
            self.low[open_[-1]] = min(self.low[open_[-1]], low[i])
        while len(open_) > 1:
            point = open_.pop()
            self._close(point, open_[-1], self.last)
        self._leaf(0)
        for name in ("depth", "parent", "lo", "hi", "rep", "low", "children", "leaves", "end", "below"):
            setattr(self, name, np.array(getattr(self, name), dtype=np.int64))
        self.n = self.members[self.hi + 1] - self.members[self.lo]

    def _point(self, depth: int, lo: int, rep: int, low: int) -> int:
        for name, value in (("depth", depth), ("parent", -1), ("lo", lo), ("hi", -1), ("rep", rep), ("low", low), ("children", 0), ("leaves", 0), ("end", -1), ("below", 0)):
            getattr(self, name).append(value)
        return len(self.depth) - 1

    def _leaf(self, point: int) -> None:
        # the next chunk may go on where the last key ends
        if not self.children[point] and not (self.end[point] == self.last and self.after == self.depth[point]):
            self.leaves[point] = 1

    def _close(self, point: int, parent: int, hi: int) -> None:
        self.parent[point], self.hi[point] = parent, hi
        self._leaf(point)
        n = int(self.members[hi + 1] - self.members[self.lo[point]])
        self.below[parent] += self.below[point] + int(self.saved(self.lo[point], self.rep[point], n, self.depth[parent] + 1, self.depth[point]))
        self.leaves[parent] += self.leaves[point]
        self.children[parent] += 1
        self.low[parent] = min(self.low[parent], self.low[point])

    def saved(self, lo, rep, n, start, stop):
        """Members, less one where the prefix is new in this chunk, times bytes, over the nodes start .. stop above a point."""
        at = self.offset[rep]
        upto = self.bytes[at + stop]
        old = np.where(lo == 0, np.clip(self.before, start - 1, stop), start - 1)
        return n * (upto - self.bytes[at + start - 1]) - (upto - self.bytes[at + old])

    def nodes(self, most: int = 20_000) -> Iterator[dict[str, np.ndarray]]:
        """Every node, point or not, in pieces of about ``most`` rows (one edge at least); point: the point at its edge's lower end."""
        steps = np.where(self.parent < 0, 1, self.depth - self.depth[self.parent])
        total = np.cumsum(steps)
        done = 0
        while done < len(steps):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")))
            point = np.repeat(np.arange(done, upto), steps[done:upto])
            depth = self.depth[point] - (np.repeat(total[done:upto], steps[done:upto]) - 1 - np.arange(total[done] - steps[done], total[upto - 1]))
            lo, hi, rep, n, parent = (x[point] for x in (self.lo, self.hi, self.rep, self.n, self.parent))
            bottom = depth == self.depth[point]
            top = (depth == self.depth[parent] + 1) & (parent >= 0)
            # the root has no text
            saved = self.below[point] + np.where(depth > 0, self.saved(lo, rep, n, np.maximum(depth, 1), self.depth[point]), 0)
            yield {
                "conv_id": self.low[point],
                "depth": depth,
                "parent_conv_id": np.where(top, self.low[parent], self.low[point]),
                "n_convs": n,
                # a way on that the chunk before has too is counted there
                "n_children": np.where(bottom, self.children[point], 1) - ((lo == 0) & (depth < self.before)),
                "n_leaves": self.leaves[point],
                "saved_tokens": saved,
                "end": np.where(bottom, self.end[point], -1),
                "shared": ((lo == 0) & (depth <= self.before)) | ((hi == self.last) & (depth <= self.after)),
                # the parent's own row is shared: its conversation is known after the sums
                "up": (depth > 0) & np.where(top, ((self.lo[parent] == 0) & (depth - 1 <= self.before)) | ((self.hi[parent] == self.last) & (depth - 1 <= self.after)), ((lo == 0) & (depth - 1 <= self.before)) | ((hi == self.last) & (depth - 1 <= self.after))),
                "rep": rep,
            }
            done = upto


def _borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """By chunk: the tokens that its first and last content share with the contents before and after (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                last = batch.column("key")[batch.num_rows - 1].as_py()
                first = batch.column("key")[0].as_py() if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["chunk", "first", "last"])

    ends = sorted(ordered.select("key").mapInArrow(run, "chunk int, first binary, last binary").collect())
    out: dict[int, tuple[int, int]] = {}
    for k, own in enumerate(ends):
        before = common_prefix(bytes(ends[k - 1]["last"]), bytes(own["first"])) if k else -1
        after = common_prefix(bytes(own["last"]), bytes(ends[k + 1]["first"])) if k + 1 < len(ends) else -1
        out[own["chunk"]] = (before, after)
    return out


def _chunks(ordered: DataFrame) -> DataFrame:
    """The nodes of each chunk; node is set where other chunks add to them, up where they add to the parent."""
    borders = _borders(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([*batches])
        if not table.num_rows:
            return
        keys = table.column("key").to_pylist()
        sizes = [np.array(s, dtype=np.int64) for s in table.column("sizes").to_pylist()]
        ends = table.column("ends").to_pylist()
        tree = Patricia(keys, sizes, table.column("n").to_pylist(), table.column("low").to_pylist(), *borders[TaskContext.get().partitionId()])

        def prefix(which: np.ndarray, depth: np.ndarray, rep: np.ndarray) -> pa.Array:
            return pa.array([hashlib.sha256(keys[r][: TOKEN * d]).digest() if w else None for w, d, r in zip(which.tolist(), depth.tolist(), rep.tolist())], pa.binary())

        for x in tree.nodes():
            plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
            parents = pa.array(x["parent_conv_id"], mask=(x["depth"] == 0) | x["up"])
            columns = [parents if c == "parent_conv_id" else pa.array(x[c]) for c in plain]
            sha = pa.array([ends[e] if e >= 0 else NOBODY for e in x["end"].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, sha, prefix(x["shared"], x["depth"], x["rep"]), prefix(x["up"], x["depth"] - 1, x["rep"])], names=[*plain, "ends_sha256", "node", "up"])

    return ordered.mapInArrow(run, COLUMNS)


def trie(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node."""
    ship(seqs.sparkSession)
    ordered = cut(contents(seqs).repartitionByRange("key").sortWithinPartitions("key"))
    nodes = stored(_chunks(ordered), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != NOBODY, F.col("ends_sha256"))), F.lit(NOBODY)).alias("ends_sha256")
    shared = nodes.where("node is not null").groupBy("node", "up", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, ends)
    parents = shared.select(F.col("node").alias("up"), F.col("conv_id").alias("found"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = nodes.where("node is null and up is null").select(*columns, "parent_conv_id")
    beside = nodes.where("node is null and up is not null").select(*columns, "up").unionByName(shared.select(*columns, "up")).join(parents, "up", "left").select(*columns, F.col("found").alias("parent_conv_id"))
    out = own.unionByName(beside)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a short ASCII string, its bytes taken one by one and each bit by bit (reflected polynomial 0xEDB88320)
_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda crc, b:
    list_reduce(range(CAST(0 AS BIGINT), CAST(8 AS BIGINT)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295)"""


def sql() -> str:
    """The same trie in SQL, for ``conversations``: nodes by their prefixes, subtrees by all ancestors of each node."""
    return f"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(sha256(strlen(r) || ':' || r || t) ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS tokens,
                   list(CAST(strlen(t) AS BIGINT) ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS sizes FROM turns GROUP BY conv_id),
    cut AS (SELECT *, {_CRC} % 9 AS h, conv_id - ((conv_id % 5) + 5) % 5 AS p FROM own),
    built AS (SELECT c.conv_id, coalesce(p.tokens[1:c.h], []) || c.tokens[c.h + 1:] AS tokens, coalesce(p.sizes[1:c.h], []) || c.sizes[c.h + 1:] AS sizes
              FROM cut c LEFT JOIN own p ON p.conv_id = c.p),
    steps AS (SELECT conv_id, d, sha256(array_to_string(tokens[1:d], ',')) AS node, sha256(array_to_string(tokens[1:d - 1], ',')) AS up, coalesce(sizes[d], 0) AS size, d = len(tokens) AS ends
              FROM built, range(0, len(tokens) + 1) AS x(d)),
    nodes AS (SELECT d, node, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
              FROM steps GROUP BY d, node),
    children AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
    under AS (SELECT DISTINCT a.d AS top_d, a.node AS top, b.d, b.node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d),
    sums AS (SELECT u.top_d, u.top, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n - 1) * n.size) AS saved_tokens
             FROM under u JOIN nodes n ON n.d = u.d AND n.node = u.node LEFT JOIN children c ON c.d = u.d AND c.node = u.node GROUP BY u.top_d, u.top)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
           CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s ON s.top_d = n.d AND s.top = n.node
    LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.up
    LEFT JOIN children c ON c.d = n.d AND c.node = n.node
    """
