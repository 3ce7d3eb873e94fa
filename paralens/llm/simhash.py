"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: 64-bit majority over the XXH64 values of a text's word shingles.
Search: two fingerprints within radius r share, of r + 2 blocks of bits, at least
two whole blocks; each fingerprint is dealt to one cell for each pair of blocks,
so all partners meet in some cell.  The fingerprints of a task's cells are sorted by
Gray rank and put under nodes that factor out the bits all of the node's members
share, one tree for each cell whatever its size; a query walks its cell's tree, adds
the differences in each node's own shared bits, and leaves a whole group once the sum
exceeds r.  All links come out of this index.  A cell with more fingerprints than
``cell_rows`` is split into sub-cells for all pairs of its salted parts, so no task
gathers an unbounded cell and no pair is lost.  A cell returns only a spanning
forest of its links (at most one row for each member), and the components of all
forests are the components of all links.

Null ids form one document with a null id; repeated rows of an id count as one
document with several fingerprints.  A null, empty or wordless text has
fingerprint zero and is linked like any other.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import cut, keyed, ship, text_and_id
from .components import components
from .xxh import xxh64

BITS = 64
U64 = np.uint64


def fingerprints_of(column: pa.Array, shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text of an Arrow array (unsigned 64-bit)."""
    words = W.words_of(column)
    out = np.zeros(len(words.count), dtype=U64)
    if not len(words):
        return out
    data, start, end = words.spaced()
    # the last word of each shingle: shingle - 1 words on, or the text's last word if the text is shorter
    per = np.where(words.count > 0, np.maximum(words.count - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(per)), per)
    begin = np.concatenate([[0], np.cumsum(per)])
    first = words.first[:-1][owner] + (np.arange(begin[-1]) - begin[owner])
    last = np.minimum(first + shingle - 1, words.first[1:][owner] - 1)
    h = xxh64(data, start[first], end[last])
    filled = np.flatnonzero(per)
    for lo in range(0, len(filled), 4096):
        some = filled[lo : lo + 4096]
        a, b = begin[some[0]], begin[some[-1] + 1]
        ones = np.zeros((len(some), BITS), dtype=np.int64)
        marks = begin[some] - a
        for byte in range(8):
            part = ((h[a:b] >> U64(8 * byte)) & U64(255)).astype(np.uint8)
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(part[:, None], axis=1, bitorder="little"), marks, axis=0, dtype=np.int64)
        majority = 2 * ones > per[some][:, None]
        out[some] = (majority.astype(U64) << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, hashed: bool = False) -> DataFrame:
    """(id, fp[, h]): the fingerprint of every text as a signed 64-bit integer, and a hash of the text."""
    ship(docs.sparkSession)
    source = text_and_id(docs, key, text)
    names = ["id", "fp"]
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())])
    if hashed:
        source, names, schema = source.withColumn("h", F.xxhash64("text")), [*names, "h"], schema.add("h", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            fp = fingerprints_of(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp), *([batch.column("h")] if hashed else [])], names=names)

    return source.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(shift)
    return rank


class GrayIndex:
    """Gray-sorted codes of cells under levels of nodes, a tree for each cell; a node keeps the bits its members share."""

    def __init__(self, codes: np.ndarray, cells: np.ndarray | None = None, fan: int = 8):
        cells = np.zeros(len(codes), dtype=np.int64) if cells is None else cells
        self.order = np.lexsort((gray_rank(codes), cells))
        self.codes = codes[self.order]
        #: the different cells, ascending; the root of each one's tree has its place
        self.cells, of_cell = np.unique(cells[self.order], return_inverse=True)
        #: of each code: its tree
        self.tree = of_cell
        # level 0: the codes, every bit of which is shared
        bits, mask = self.codes, np.full(len(codes), ~U64(0))
        last = np.arange(len(codes))
        self.levels = [[bits, mask, None, None, last]]
        while len(bits) > len(self.cells):
            count = np.bincount(of_cell, minlength=len(self.cells))
            nth = np.arange(len(bits)) - np.repeat(np.cumsum(count) - count, count)
            marks = np.flatnonzero(nth % fan == 0)
            high, low = np.bitwise_and.reduceat(bits & mask, marks), np.bitwise_and.reduceat(~bits & mask, marks)
            children = np.diff(marks, append=len(bits))
            bits, shared, of_cell, last = high, high | low, of_cell[marks], last[marks + children - 1]
            # what a parent shares is taken out of its children
            self.levels[-1][1] = mask & ~np.repeat(shared, children)
            mask = shared
            self.levels.append([bits, mask, marks, children, last])

    def within(self, queries: np.ndarray, radius: int, trees: np.ndarray | None = None, after: np.ndarray | None = None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) places of all pairs within the radius, members in Gray order.

        ``trees``: each query's tree (the only one if not given).  ``after``: places
        up to which members are of no interest to a query.
        """
        trees = np.zeros(len(queries), dtype=np.int64) if trees is None else trees
        if not len(self.codes):
            return
        stack = [(len(self.levels) - 1, np.arange(len(queries)), trees, np.zeros(len(queries), dtype=np.uint8))]
        while stack:
            k, q, node, so_far = stack.pop()
            if len(q) > most:
                half = len(q) // 2
                stack += [(k, q[half:], node[half:], so_far[half:]), (k, q[:half], node[:half], so_far[:half])]
                continue
            bits, mask, first, children, last = self.levels[k]
            so_far = so_far + np.bitwise_count((queries[q] ^ bits[node]) & mask[node])
            keep = so_far <= radius
            if after is not None:
                keep &= last[node] > after[q]
            q, node, so_far = q[keep], node[keep], so_far[keep]
            if not len(q):
                continue
            if k == 0:
                yield q, node
                continue
            per = children[node]
            ends = np.cumsum(per)
            below = np.arange(ends[-1]) + np.repeat(first[node] - (ends - per), per)
            stack.append((k - 1, np.repeat(q, per), below, np.repeat(so_far, per)))

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs of codes of one cell within the radius."""
        places = np.arange(len(self.codes))
        return self.within(self.codes, radius, self.tree, places)


def forest(codes: np.ndarray, radius: int, cells: np.ndarray | None = None) -> np.ndarray:
    """For the codes of cells, each one's representative: equal for codes of a cell that are linked within the radius."""
    index = GrayIndex(codes, cells)
    root = np.arange(len(codes))
    for a, b in index.links(radius):
        while True:
            # hook the larger root below the smaller, then flatten; repeat until the pairs agree
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            a, b = a[differ], b[differ]
    out = np.empty_like(root)
    out[index.order] = index.order[root]
    return out


def block_masks(radius: int) -> list[int]:
    """Masks of radius + 2 blocks of neighbouring bits that cover the fingerprint."""
    edges = [BITS * k // (radius + 2) for k in range(radius + 3)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, radius: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(a, b): a spanning forest of all links between the distinct fingerprints in column ``fp``."""
    ship(fps.sparkSession)
    distinct = fps.select("fp").distinct()
    masks = [_signed(x | y) for x, y in combinations(block_masks(radius), 2)]
    cells = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).cast("smallint").alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])).alias("c"),
    ).select("fp", "c.pair", "c.part")
    sizes = cells.groupBy("pair", "part").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(cell_rows)).cast("int")
    spread = cells.join(sizes, ["pair", "part"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = spread.select(
        "pair",
        "part",
        "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j) * F.col("parts") + F.greatest("own", j))).alias("sub"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solved(rows: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            sizes = np.diff(marks)
            codes = rows[3][marks[0] : marks[-1]].view(U64)
            root = forest(codes, radius, np.repeat(np.arange(len(sizes)), sizes))
            own = np.flatnonzero(codes[root] != codes)
            return pa.RecordBatch.from_arrays([pa.array(codes[own].view(np.int64)), pa.array(codes[root[own]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("pair", "part", "sub", "fp")])
            held.append(rows)
            if (rows[:3, -1] == held[0][:3, 0]).all() and (rows[:3, -1] == rows[:3, 0]).all():
                continue  # the cell goes on
            rows = np.concatenate(held, axis=1)
            marks = np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1
            if len(marks):
                yield solved(rows, np.concatenate([[0], marks]))
                rows = rows[:, marks[-1] :]
            held = [rows]
        if held:
            rows = np.concatenate(held, axis=1)
            marks = np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1
            yield solved(rows, np.concatenate([[0], marks, [rows.shape[1]]]))

    grouped = dealt.repartition("pair", "part", "sub").sortWithinPartitions("pair", "part", "sub")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(id, fp, component): each document's fingerprint and the smallest id it is linked to.

    Links join fingerprints that differ in at most ``radius`` bits; components are
    their transitive closure.  A document whose id is null has a null component
    unless an id that is not null shares its component.
    """
    return _grouped(docs, key, text, shingle, radius, cell_rows).select("id", "fp", "component")


def _grouped(docs: DataFrame, key: str, text: str, shingle: int = 4, radius: int = 4, cell_rows: int = 20_000, hashed: bool = False) -> DataFrame:
    """near_duplicates() with the root fingerprint of each component and, if asked for, a hash of the text."""
    rows = cut(fingerprints(docs, key, text, shingle, hashed))
    names = ["root", *["h"] * hashed]
    forest_ = components(links(rows, radius, cell_rows))
    lows = rows.groupBy("fp").agg(F.min("id").alias("low"))
    rooted = lows.join(forest_, lows["fp"] == forest_["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component"))
    # an id with several fingerprints joins their components
    several = rows.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y and id is not null").limit(1).count()
    named = cut(rooted.join(least, "root").select("fp", "component", "root"))
    out = rows.join(named, "fp")
    if several:
        joined = out.groupBy("id").agg(F.min("component").alias("low"))
        pairs = out.where("id is not null").join(joined, "id").select("component", "low")
        again = components(pairs).withColumnRenamed("root", "low")
        out = out.join(again, out["component"] == again["node"], "left").select("id", "fp", F.coalesce("low", "component").alias("component"), *names)
    return out.select("id", "fp", "component", *names)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id, the one with the least hash of the text.

    All columns are kept.  A row with a null id stays only if no id that is not null
    is in its component.
    """
    found = _grouped(docs, key, text, hashed=True, **options).where(F.col("id").eqNullSafe(F.col("component")))
    # components without an id are told apart by their root fingerprints
    keep = found.groupBy("id", F.when(F.col("id").isNull(), F.col("root")).alias("root")).agg(F.min("h").alias("least"))
    rows = keyed(docs, key).withColumn("h", F.xxhash64(F.col("row").getField(text).cast("string")))
    kept = rows.join(keep, rows["k"].eqNullSafe(keep["id"]) & (rows["h"] == keep["least"]))
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("k", "h").orderBy(F.xxhash64("row")))).where("nth = 1")
    return one.select("row.*")
