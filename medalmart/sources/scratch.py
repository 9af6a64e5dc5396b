"""Shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="medalmart-")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master one is made if none is set."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    return _local_root()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
