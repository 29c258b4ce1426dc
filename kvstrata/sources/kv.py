"""Versioned key-value logs (cf, key, seq, op, value) made from the test tables, and their file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.sources.tables import table

KV_SCHEMA = "cf int, key string, seq long, op string, value string"
FILE_SCHEMA = "file_id long, cf int, level int, file_size long, smallest string, largest string, smallest_seq long, largest_seq long, num_entries long, num_deletions long, being_compacted boolean"
#: Events per level-0 file and per batch, users per level-1 file.
BATCH, USERS_PER_FILE, LEVEL1_BASE = 100, 5, 1_000_000


def _padded(column: str):
    return F.lpad(F.col(column).cast("string"), 10, "0")


def kv_from_events(events: DataFrame, *extra) -> DataFrame:
    """The events as a log: an error deletes the user's entry, anything else puts its props."""
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("PUT")
    value = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("props"))
    return events.select((F.col("user_id") % 3).cast("int").alias("cf"), _padded("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), value.alias("value"), *extra)


def kv_events(spark: SparkSession, d: str, *extra) -> DataFrame:
    """The primary log."""
    return kv_from_events(table(spark, d, "events"), *extra)


def kv_orders(spark: SparkSession, d: str) -> DataFrame:
    """The secondary log: finished orders delete, others put their priority."""
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 3).cast("int").alias("cf"), _padded("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"),
        F.when(done, "DEL").otherwise("PUT").alias("op"), F.when(done, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("value"),
    )


def log_keys(spark: SparkSession, d: str) -> DataFrame:
    """(db_id, cf, key): the distinct keys of the change log."""
    return table(spark, d, "kv_log").where("user_key IS NOT NULL").select("db_id", "cf", F.col("user_key").alias("key")).distinct()


def events_with_files(spark: SparkSession, d: str, level: int) -> DataFrame:
    """The primary log with the id of the file of one level that holds each row."""
    file_id = F.floor(F.col("event_id") / BATCH) if level == 0 else F.floor(F.col("user_id") / USERS_PER_FILE) + LEVEL1_BASE
    return kv_events(spark, d, file_id.cast("long").alias("file_id")).withColumn("level", F.lit(level))
