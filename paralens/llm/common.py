"""What the operators of this subpackage share: inputs, scratch tables, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path may belong to any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where none is set, a local one in local mode (tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint that survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows written once as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives the workers of all machines the package, once for each application."""
    from ..operators import groupwise

    groupwise.ship(spark)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """(k, row): the key beside the whole row as a struct, so that no column name can clash."""
    return docs.select(F.col(key).alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def text_and_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) only, so that extra columns neither clash nor are read."""
    return docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))


def whole_groups(batches, keys: list[str]):
    """Batches sorted by ``keys``, cut anew so that no group of equal keys is split between two."""
    import numpy as np
    import pyarrow as pa

    from .words import give_back

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(batch.num_rows, dtype=bool)
        for v, k in zip(values, keys):
            differs[1:] |= v[1:] != v[:-1]
            differs[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        marks = np.flatnonzero(differs)
        if len(marks):
            last = int(marks[-1])
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    give_back()
