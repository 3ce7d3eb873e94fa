"""Tables of the engine in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The shared folder; where none is set, a local one in local mode (tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Packed columns look small to the planner; the hint keeps it from gathering such a table in the driver to broadcast it.
JOINED = "merge"
#: Most of what lies in the tables is text.
CODEC = "zstd"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows written once as Parquet and read from there: lineage ends, columns stay prunable."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint(JOINED)


def bucketed(df: DataFrame, name: str, keys: list[str], n: int, dealt: bool = False) -> DataFrame:
    """stored(), dealt to ``n`` buckets by ``keys``: joins, groups and windows on them, or on more columns, need no shuffle.

    Rows are dealt before they are written, so each bucket is one file; ``dealt`` rows lie by the keys already.
    """
    spark = df.sparkSession
    # tables on the same keys may be joined on more columns without a new shuffle
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("compression", CODEC).option("path", f"{shared(spark)}/{table}").saveAsTable(table)
    return spark.table(table).hint(JOINED)


def together(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """The tables that the makers store, made at the same time; no two of them may need the same unmade table."""
    with ThreadPoolExecutor(len(makers)) as pool:
        inherit = inheritable_thread_target(spark)
        return [job.result() for job in [pool.submit(inherit(make)) for make in makers]]


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that stored() or bucketed() made."""
    spark = df.sparkSession
    root = shared(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(conf).delete(path, True)
