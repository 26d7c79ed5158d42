"""Session helpers: the shared folder, checkpoints and tables handed over through files."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh
    temporary folder, which is remembered in the session.
    """
    named = spark.conf.get(_CHECKPOINT_CONF, None) or spark.conf.get("sceneforge.shared.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="sceneforge-")
    spark.conf.set("sceneforge.shared.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Give the context a checkpoint folder unless the cluster already did."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark) + "/checkpoints")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file where none is; False if there is one. Of several that try at a time one succeeds.

    HDFS and local folders promise that; an object store does if it refuses to create a file twice.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    uri = files.makeQualified(where).toUri()
    try:
        if uri.getScheme() == "file":  # Hadoop's local files look first and create after
            os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL))
        else:
            files.create(where, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError:
        if files.exists(where):
            return False
        raise
    return True


def release(spark: SparkSession, path: str) -> None:
    """Take back what ``claim`` created."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the files.

    What follows can read it several times without computing it again, and a
    lost executor costs no more than reading its files elsewhere.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
