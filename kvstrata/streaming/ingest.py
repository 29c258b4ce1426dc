"""Structured Streaming ingest of a change log.

Each micro-batch is folded to the newest version per key and stored under its
batch id, so a batch that runs again after a failure replaces itself.  Order
between batches does not matter, as the newest version is found by sequence
number; hence late operations need no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvstrata.operators.read import newest, visible
from kvstrata.sources.kv import KV_SCHEMA
from kvstrata.sources.pointer import Pointer
from kvstrata.sources.scratch import scratch_path

#: Stored micro-batches from which on they are folded into one table.
FOLD_AT = 16


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over one table, be it a Parquet file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else reader.parquet(path)


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Ids of the stored micro-batches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")) if fs.exists(at) else []


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, list[int], dict]:
    """(versions, batches not folded yet, what is folded)."""
    done = Pointer(spark, f"{root}/FOLDED").read() or {"fold": 0, "next": 0}
    fresh = [b for b in _batches(spark, root) if b >= done["next"]]
    paths = [f"{root}/rows/batch={b}" for b in fresh] + ([f"{root}/folds/{done['fold']}"] if done["fold"] else [])
    rows = spark.read.schema(KV_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], KV_SCHEMA)
    return rows, fresh, done


def fold_batches(spark: SparkSession, root: str, most: int = FOLD_AT) -> bool:
    """Fold the micro-batches into one table of newest versions if there are more than ``most``; published by one rename.

    A batch that runs again later adds versions the fold holds already, which changes nothing."""
    rows, fresh, done = _stored(spark, root)
    if len(fresh) <= most:
        return False
    newest(rows).write.mode("overwrite").parquet(f"{root}/folds/{done['fold'] + 1}")
    Pointer(spark, f"{root}/FOLDED").publish({"fold": done["fold"] + 1, "next": fresh[-1] + 1})
    return True


def stream_apply(stream: DataFrame, to_log: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """The live entries after all that the stream holds now; ``to_log`` gives the (cf, key, seq, op, value) rows of a batch.

    With a ``root`` of its own, a later call goes on where this one ended."""
    spark = stream.sparkSession
    root = root or scratch_path(spark)

    def store(batch: DataFrame, batch_id: int) -> None:
        newest(to_log(batch).where("key IS NOT NULL AND seq IS NOT NULL")).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    fold_batches(spark, root)
    return visible(_stored(spark, root)[0])
