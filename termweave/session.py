"""Session helpers: session settings, the shared folder, cut lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small. At a few hundred bytes a row this stays far below an executor's memory.
BROADCAST_ROWS = 100_000

_written: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("termweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="termweave-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use; release() deletes what is written there."""
    path = f"{shared_folder(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start there, also after the loss of an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end of the block what was written in the shared folder within it, so that long sessions don't fill it.

    Results of the block must have been written, or taken to the driver, before it ends.
    """
    before = set(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete what this session wrote in the shared folder. Results that still read it must have been written before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _written[spark.sparkContext.applicationId] = [p for p in paths if p in keep]
    for path in (p for p in paths if p not in keep):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where df, a table already written by cut(), has at most so many rows; else leave a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores, for work that is heavy per row.

    Only an input smaller than the cluster, in few files, is exchanged for that; larger ones stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
