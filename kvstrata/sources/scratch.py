"""Lineage cuts: intermediate tables written to the shared checkpoint folder.

The folder is the one the session names in ``spark.checkpoint.dir``.  Where that
is unset, a session whose executors are threads of this process (``local[n]``)
uses a temporary folder, and any other raises an error, as its executors may lie
on other machines.  Tables are compressed Parquet, so that they take far less
room than serialised rows, every executor can read them, and the loss of an
executor costs nothing.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def _local_folder(app: str, master: str) -> str:
    """A temporary folder for a session of one process; an error for any other."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kvstrata-")
    return _LOCAL[app]


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application inside the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        base = _local_folder(app, spark.sparkContext.master)
    return f"{base.rstrip('/')}/kvstrata-{app}"


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the scratch folder; it goes away when the application's JVM ends."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` to be broadcast if its measured ``rows`` are at most ``most``, otherwise to be shuffled and merged.

    Left to itself, Spark would go by the compressed size of a stored table, which
    may be a small part of its size in memory."""
    return df.hint("broadcast" if rows <= most else "merge")
