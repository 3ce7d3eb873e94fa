"""Sequential work for each group of rows, in Arrow batches.

Groups are dealt by their keys and sorted; a task cuts its stream of batches where
the keys change and hands each group to a plain function over numpy arrays.  This
avoids one worker call for each group, of which there are as many as pages.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: bytes of rows that travel to a worker at once; Arrow's buffers double as they grow, in the executor and in the worker
BATCH = 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Gives the workers of all machines the package, once for each application, and bounds the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_paralens_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "paralens.zip")
    package = os.path.join(ROOT, "paralens")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    sc.addPyFile(path)
    sc._paralens_shipped = True


def per_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``keys`` and what ``solve`` returns for each group's columns (arrays in ``order``).

    ``solve`` returns arrays of one length; none or empty ones give no rows.
    ``schema`` names the keys first.
    """

    def each(columns: dict[str, np.ndarray], marks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        found, sizes, at = [], [], []
        for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist()):
            own = solve({c: v[lo:hi] for c, v in columns.items()})
            n = len(next(iter(own.values()))) if own else 0
            if n:
                found.append(own)
                sizes.append(n)
                at.append(lo)
        return np.repeat(np.array(at, dtype=np.int64), sizes), {c: np.concatenate([f[c] for f in found]) for c in found[0]} if found else {}

    return per_groups(df, keys, order, each, schema)


def per_groups(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """per_group() for a function that takes many whole groups at once.

    ``solve`` gets the columns and the places where groups begin, and the end; it returns, for each
    row found, a place in the row's group, and the rows' columns.  Rows are numbered within their group,
    which brings them together and in order, needs no shuffle where they lie by the keys already,
    and tells where groups begin.
    """
    ship(df.sparkSession)
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            firsts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if len(firsts):
                at = int(firsts[-1])
                if held or at:
                    yield _one([*held, batch.slice(0, at)])
                held = []
                batch = batch.slice(at)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield _one(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            marks = np.append(np.flatnonzero(table.column("nth").to_numpy() == 1), table.num_rows)
            at, found = solve({c: table.column(c).to_numpy(zero_copy_only=False) for c in table.schema.names if c not in keys}, marks)
            if len(at):
                rows = pa.array(at)
                columns = [table.column(f.name).take(rows) if f.name in keys else pa.array(found[f.name], from_pandas=True) for f in kinds]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

    numbered = df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.mapInArrow(run, schema)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches end to end."""
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def ends(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, end to end, and the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def runs(begin: np.ndarray, length: np.ndarray, step: np.ndarray | int = 1) -> np.ndarray:
    """begin[0], begin[0] + step[0], .. (length[0] places), begin[1], .. : the places of ragged rows, end to end."""
    at = ends(length)
    nth = np.arange(at[-1]) - np.repeat(at[:-1], length)
    return np.repeat(begin, length) + nth * (np.repeat(step, length) if np.ndim(step) else step)


def portions(work: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of items whose work together is at most ``most`` (one item at least)."""
    total, lo = np.cumsum(work), 0
    while lo < len(work):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi
