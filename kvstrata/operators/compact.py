"""Compaction of a versioned log under live snapshots.

Between two neighbouring snapshots only the newest version of a key can be seen,
so each (key, stripe) keeps one row.  The first window is limited per task
before its shuffle and leaves at most one row per key and stripe, so the second
one, which looks at older stripes for the tombstone rule, has little to move and
no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.functions.keys import MAX_SEQUENCE
from kvstrata.operators.changes import null_safe_join
from kvstrata.operators.ordering import blocked_sums, in_ranges
from kvstrata.operators.read import newest
from kvstrata.sources.scratch import durable

VERSION = ["cf", "key", "seq", "op", "value"]


def stripe(snapshots: list[int]) -> Column:
    """The least snapshot at or above seq, or the greatest sequence number there is."""
    out = F.lit(MAX_SEQUENCE)
    for s in sorted(set(snapshots), reverse=True):
        out = F.when(F.col("seq") <= s, F.lit(s).cast("long")).otherwise(out)
    return out


def previous_snapshot(snapshots: list[int]) -> Column:
    """The greatest snapshot below seq, or 0."""
    out = F.lit(0).cast("long")
    for s in sorted(set(snapshots)):
        out = F.when(F.col("seq") > s, F.lit(s).cast("long")).otherwise(out)
    return out


def compact(kv: DataFrame, snapshots: list[int] | tuple = (), bottommost: bool = False) -> DataFrame:
    """The versions that a compaction keeps; at the bottommost level a tombstone with nothing older below it goes."""
    kept = newest(kv.where("key IS NOT NULL AND seq IS NOT NULL").select(*VERSION).withColumn("stripe", stripe(list(snapshots))), ["cf", "key", "stripe"])
    if not bottommost:
        return kept.select(*VERSION)
    older = F.lead("seq").over(Window.partitionBy("cf", "key").orderBy(F.desc("seq")))
    return kept.withColumn("older", older).where("NOT (op = 'DEL' AND older IS NULL)").select(*VERSION)


def file_stats(kv: DataFrame, by: list[str], collectors: list[Column] | tuple = ()) -> DataFrame:
    """Metadata per file: key and sequence ranges, entries, deletions, raw bytes, and any further aggregates."""
    return kv.groupBy(*by).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("num_entries"),
        F.count_if(F.col("op") == "DEL").alias("num_deletions"), F.sum(F.octet_length("key").cast("long")).alias("raw_key_bytes"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")).alias("raw_value_bytes"), *collectors,
    )


def flush(kv: DataFrame, snapshots: list[int] | tuple = ()) -> DataFrame:
    """One level-0 file per family from unsaved versions: its metadata."""
    return file_stats(compact(kv, snapshots), ["cf"])


def split_files(kv: DataFrame, target_bytes: int, snapshots: list[int] | tuple = (), bottommost: bool = False) -> DataFrame:
    """Compaction output with ``file_no`` per family: cut where the running bytes of keys and values pass multiples of ``target_bytes``; all versions of a key lie in one file.

    A file exceeds the target by at most the versions of one key."""
    kept = durable(compact(kv, snapshots, bottommost).withColumn("_size", (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")))
    keys = in_ranges(kept.groupBy("cf", "key").agg(F.sum("_size").alias("_bytes")), ["cf", "key"])
    run = blocked_sums(keys, ["cf"], F.col("_range"), ["key"], ["_bytes"])
    cuts = run.select("cf", "key", F.expr(f"(run__bytes - _bytes) DIV {int(target_bytes)}").alias("file_no"))
    return null_safe_join(kept.drop("_size"), cuts.hint("merge"), ["cf", "key"], "inner")

