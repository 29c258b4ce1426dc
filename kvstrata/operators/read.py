"""Reads of a versioned log (cf, key, seq, op, value): newest visible versions, scans, cursors, as-of lookups.

The snapshot bound goes before the choice of the newest version and the test for
tombstones after it.  ``seq`` and ``key`` are compared as stored, so the bounds
reach the Parquet scan.  The newest version is row 1 of a window, which Spark
limits per task before the shuffle, so a hot key sends one row per task.
Rows with a null key or seq are not versions of anything and are never returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.operators.skew import thinned
from kvstrata.sources.scratch import durable

ENTRY = ["cf", "key", "seq", "value"]


def at_snapshot(kv: DataFrame, snapshot: int | None) -> DataFrame:
    """The versions that a snapshot sees."""
    kv = kv.where("key IS NOT NULL AND seq IS NOT NULL")
    return kv if snapshot is None else kv.where(F.col("seq") <= snapshot)


def newest(kv: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The newest version of each key, tombstones included."""
    w = Window.partitionBy(*(by or ["cf", "key"])).orderBy(F.desc("seq"), F.desc("op"))
    return kv.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def visible(kv: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(cf, key, seq, value) of the live keys at a snapshot, in no order."""
    return newest(at_snapshot(kv, snapshot)).where("op = 'PUT'").select(*ENTRY)


def point_get(kv: DataFrame, cf: int, key: str, snapshot: int | None = None) -> DataFrame:
    """The visible entry of one key, or no row."""
    return visible(kv.where((F.col("cf") == cf) & (F.col("key") == key)), snapshot)


def multi_get(kv: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(cf, key, seq, value, found) for every distinct asked key (cf, key)."""
    asked = keys.select("cf", "key").distinct()
    got = visible(kv.join(asked, ["cf", "key"], "left_semi"), snapshot)
    return asked.join(got, ["cf", "key"], "left").select(*ENTRY, F.col("seq").isNotNull().alias("found"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All versions of several sources; which source is newer plays no part, as sequence numbers are unique."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def pruned_get(kv: DataFrame, files: DataFrame, cf: int, key: str, snapshot: int | None = None) -> DataFrame:
    """As point_get, reading only rows of files whose key and sequence ranges can hold the answer."""
    hit = files.where((F.col("smallest") <= key) & (F.col("largest") >= key))
    if snapshot is not None:
        hit = hit.where(F.col("smallest_seq") <= snapshot)
    return point_get(kv.join(hit.select("file_id"), "file_id", "left_semi"), cf, key, snapshot)


def scan(kv: DataFrame, snapshot: int | None = None, reverse: bool = False, bounds: Column | None = None) -> DataFrame:
    """Live entries in key order (or against it), within bounds on the stored columns."""
    kept = kv if bounds is None else kv.where(bounds)
    order = [F.desc("cf"), F.desc("key")] if reverse else [F.asc("cf"), F.asc("key")]
    return visible(kept, snapshot).orderBy(*order)


def key_range(start: str | None = None, end: str | None = None) -> Column:
    """start <= key < end."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("key") >= start)
    return out & (F.col("key") < end) if end is not None else out


def versions(kv: DataFrame, bounds: Column, snapshot: int | None = None) -> DataFrame:
    """All versions within bounds, keys ascending, newest first."""
    return at_snapshot(kv.where(bounds), snapshot).select("cf", "key", "seq", "op", "value").orderBy("cf", "key", F.desc("seq"))


def page(kv: DataFrame, cf: int, n: int, start: Column | None = None, reverse: bool = False, snapshot: int | None = None) -> DataFrame:
    """The first ``n`` live entries of a family from a place on.

    Keys are resolved with their newest (seq, op) alone, folded map-side to one
    number per key; only the page's keys, at most n, then fetch their values."""
    rows = at_snapshot(kv.where(F.col("cf") == cf), snapshot)
    rows = rows if start is None else rows.where(start)
    rank = F.shiftleft("seq", 1) + (F.col("op") == "PUT").cast("long")
    live = rows.groupBy("cf", "key").agg(F.max(rank).alias("rank")).where("rank % 2 = 1").select("cf", "key", F.shiftright("rank", 1).alias("seq"))
    first = live.orderBy(F.desc("key") if reverse else F.asc("key")).limit(n)
    return rows.where("op = 'PUT'").join(F.broadcast(first), ["cf", "key", "seq"]).select(*ENTRY)


def seek(kv: DataFrame, cf: int, target: str, reverse: bool = False, snapshot: int | None = None) -> DataFrame:
    """First live entry at or after the target, or last one at or before it."""
    return page(kv, cf, 1, F.col("key") <= target if reverse else F.col("key") >= target, reverse, snapshot)


def as_of(kv: DataFrame, probes: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(cf, key, snapshot, seq, value): per probe (cf, key, snapshot) the entry that the snapshot sees.

    Versions and probes are put in one order per key, and the newest (seq, op) at
    or before each probe is carried forward as one number: first within blocks of
    ``width`` sequence numbers, then from block to block, so a hot key is many
    tasks and no version meets a probe in a pair.  Values are fetched at the end, and
    only those of the answers are shuffled."""
    keys = ["cf", "key"]
    block = lambda c: F.floor(F.col(c) / width).cast("long").alias("block")
    asked = probes.where("key IS NOT NULL AND snapshot IS NOT NULL").select(*keys, F.col("snapshot").cast("long").alias("snapshot")).distinct()
    rows = at_snapshot(kv, None)
    rank = F.shiftleft("seq", 1) + (F.col("op") == "PUT").cast("long")
    points = rows.select(*keys, block("seq"), F.col("seq").alias("at"), rank.alias("rank"), F.lit(None).cast("long").alias("snapshot"))
    points = points.unionByName(asked.select(*keys, block("snapshot"), F.col("snapshot").alias("at"), F.lit(None).cast("long").alias("rank"), "snapshot"))
    inside = F.max("rank").over(Window.partitionBy(*keys, "block").orderBy("at", F.col("snapshot").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    here = points.withColumn("newest", inside).where("snapshot IS NOT NULL").select(*keys, "block", "snapshot", "newest")
    earlier = F.max("top").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = points.groupBy(*keys, "block").agg(F.max("rank").alias("top")).withColumn("earlier", earlier).drop("top")
    same = F.col("cf").eqNullSafe(F.col("_cf")) & (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block"))
    seen = here.join(before.withColumnsRenamed({"cf": "_cf", "key": "_key", "block": "_block"}), same).withColumn("newest", F.coalesce("newest", "earlier"))
    seen = durable(seen.where("newest % 2 = 1").select(*keys, "snapshot", F.shiftright("newest", 1).alias("seq")))
    entry = F.xxhash64("cf", "key", "seq")
    held = thinned(rows.where("op = 'PUT'").select(*keys, "seq", "value"), entry, seen, entry, seen.count()).dropDuplicates([*keys, "seq"])
    values = held.withColumnsRenamed({"cf": "_cf", "key": "_key", "seq": "_seq"})
    same = F.col("cf").eqNullSafe(F.col("_cf")) & (F.col("key") == F.col("_key")) & (F.col("seq") == F.col("_seq"))
    return seen.join(values.hint("merge"), same).select(*keys, "snapshot", "seq", "value")
