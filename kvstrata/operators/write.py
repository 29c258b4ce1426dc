"""Batches of writes: sequence assignment, atomic publication, ingestion of outside files.

A batch is rows with ``batch_id`` and ``ordinal``; each operation gets the next
sequence number after those of all earlier batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.operators.ordering import running_total
from kvstrata.operators.read import newest


def tombstones(kv: DataFrame) -> DataFrame:
    """The delete operations; their value is null."""
    return kv.where("op = 'DEL'").select("cf", "key", "seq", "op", F.lit(None).cast("string").alias("value"))


def batch_operations(ops: DataFrame) -> DataFrame:
    """(batch_id, cf, op, n_ops, n_bytes): what each batch does; bytes of keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return ops.groupBy("batch_id", "cf", "op").agg(F.count("*").alias("n_ops"), F.sum(size).cast("long").alias("n_bytes"))


def assign_sequence(ops: DataFrame, last: int = 0) -> DataFrame:
    """(batch_id, first_seq, last_seq, n_ops): contiguous numbers for the batches in order of their id, from ``last`` + 1 on."""
    sizes = ops.groupBy("batch_id").agg(F.count("*").alias("n_ops"))
    ends = running_total(sizes, "batch_id", F.col("n_ops"), "end")
    return ends.select("batch_id", (F.col("end") - F.col("n_ops") + 1 + last).alias("first_seq"), (F.col("end") + last).alias("last_seq"), "n_ops")


def number_operations(ops: DataFrame, last: int = 0) -> DataFrame:
    """``ops`` with ``seq``: the batch's first number plus the place of the operation in its batch (column ordinal, from 0)."""
    return ops.join(assign_sequence(ops, last).select("batch_id", "first_seq"), "batch_id").withColumn("seq", F.col("first_seq") + F.col("ordinal")).drop("first_seq")


def commit_watermark(published: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row (last_batch, last_seq): the end of the longest prefix of batches without a gap; nulls if the first is missing."""
    gap = assigned.join(published.select("batch_id").distinct(), "batch_id", "left_anti").agg(F.min("batch_id")).first()[0]
    seen = assigned if gap is None else assigned.where(F.col("batch_id") < gap)
    return seen.agg(F.max("batch_id").alias("last_batch"), F.max("last_seq").alias("last_seq"))


def ingest_global_sequence(kv: DataFrame, outside: DataFrame) -> DataFrame:
    """All versions after an outside file (one row per key: cf, key, op, value) came in at one sequence number above all others."""
    top = (kv.agg(F.max("seq")).first()[0] or 0) + 1
    cols = ["cf", "key", "seq", "op", "value"]
    return kv.select(cols).unionByName(outside.withColumn("seq", F.lit(top).cast("long")).select(cols))


def one_per_key(kv: DataFrame) -> DataFrame:
    """The newest version of each key, as an outside file needs it."""
    return newest(kv)


def family_catalog(edits: DataFrame) -> DataFrame:
    """(db_id, cf, cf_name, edit_no) of the families that exist at the end; family 0 exists without an edit and is not listed."""
    changes = edits.where(F.col("kind").isin("ADD_CF", "DROP_CF") & F.col("cf").isNotNull())
    last = changes.groupBy("db_id", "cf").agg(F.max(F.struct("edit_no", "kind", "cf_name")).alias("c"))
    return last.where("c.kind = 'ADD_CF'").select("db_id", "cf", "c.cf_name", "c.edit_no")
