"""Cutting lineage through the folder that the driver and all executors share.

The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
unset and the session runs in one process (tests, notebooks) is a temporary
folder made and used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="ledgerlink-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return f"file://{_LOCAL[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What comes after no longer depends on shuffle files of lost executors, and
    a plan that is used twice runs once.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_root(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        # inputFiles writes file:///x, the root may be file:/x or a plain path
        if root.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
