"""Tables and folders in the place that the whole cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
back.  Executors may be lost at any time: the table stays readable, so a later stage
recomputes nothing above it.  Only where no such folder is configured does this module choose
one itself, on a single machine (tests, a laptop); on a cluster it raises.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, as a URI."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = context._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vellum-shared-')}"
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: Lists that get the path of every folder made while they are open.
_watching: list[list[str]] = []


@contextmanager
def watched() -> Iterator[list[str]]:
    """The paths of the folders that are made meanwhile."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders whose readers have ended."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/vellum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    for made in _watching:
        made.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read from the shared folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The POSIX path of a ``file:`` URI; files that are memory-mapped need one."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped files need a shared folder with a POSIX path (file:)")
    return uri


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that would clash with ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


#: Rows of a few numbers that are small enough to be sent to every executor.
SENDABLE = 1_000_000


def sendable(keys: DataFrame, most: int = SENDABLE) -> DataFrame:
    """``keys`` (narrow rows) marked for broadcast if they are counted to be few, else for a sort-merge join."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")
