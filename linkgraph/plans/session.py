"""Session helpers: reading tables, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only below this many rows, counted first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, whatever store it is on, and the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a path; empty if there is none."""
    fs, p = path_of(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))) if fs.exists(p) else ()


_BUILT: dict[tuple, object] = {}


def once(spark: SparkSession, paths: list[str], name: str, build: Callable[[], object]) -> object:
    """What build gives (checkpointed tables), made once a session for the same files."""
    key = (spark.sparkContext.applicationId, name, tuple(stamp(spark, p) for p in paths))
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key[0]]:  # of sessions that have ended
            del _BUILT[old]
        _BUILT[key] = build()
    return _BUILT[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see: the session's ``spark.checkpoint.dir``.

    Only on one machine (a local master) a temporary folder is used where that is unset; on a
    cluster that is an error, as each machine would have a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="linkgraph-checkpoint-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder; survives the loss of executors.

    The files go when the table is no longer referenced, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else with the folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder: as reliable as a checkpoint, but compressed and read by columns.

    For large tables; the files stay until the session ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    fs, p = path_of(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only if the counted number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
