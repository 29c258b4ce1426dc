"""Current state from a feed of inserts, updates and deletes.

Method: newest-first resolution.  The feed is cut into batches by its order
column (so late and repeated rows fall where they belong, whenever they came),
and the batches are taken backwards: the newest change of each key within the
batch, found by partial aggregation, is kept if no newer batch has resolved the
key (anti join); a delete is kept as a tombstone.  At last the rows of the base
table whose keys no change touched are appended.

The batch limits are quantiles, so the filters are plain comparisons that reach
the Parquet scan, and a batch is about 1/n of the feed however it is spread.
One hot key is folded map-side to one row per task and batch.

Defined results: changes without an order value change nothing; key columns may
be null and compare as equal then; repeated rows of one change count once; of two
different changes with one order value a put wins over a delete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.sources.scratch import durable
from kvstrata.sources.tables import file_number

BATCHES = 4


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by keys of which nulls are equal; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def batch_limits(feed: DataFrame, order: str, batches: int) -> list[int]:
    """Ascending order values that cut the feed into about equal batches."""
    if batches < 2:
        return []
    cuts = feed.agg(F.percentile_approx(order, [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def resolve_newest_first(feed: DataFrame, keys: list[str], order: str, is_put: Column, images: list[str] | None = None, batches: int = BATCHES) -> DataFrame:
    """(keys, order, is_put, images): the newest change of each key, tombstones included."""
    images = images or []
    feed = feed.where(F.col(order).isNotNull()).select(*keys, order, *images, F.coalesce(is_put, F.lit(False)).alias("is_put"))
    limits = batch_limits(feed, order, batches)
    edges = [None, *limits, None]
    resolved: DataFrame | None = None
    rank = F.shiftleft(F.col(order).cast("long"), 1) + F.col("is_put").cast("long")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        part = feed
        if lo is not None:
            part = part.where(F.col(order) >= lo)
        if hi is not None:
            part = part.where(F.col(order) < hi)
        image = [F.max(F.struct(rank.alias("r"), *images)).alias("image")] if images else []
        newest = part.groupBy(*keys).agg(F.max(rank).alias("rank"), *image)
        if resolved is not None:
            newest = null_safe_join(newest, resolved.hint("merge"), keys, "left_anti")  # grows with the feed, so it is never broadcast
        found = durable(newest)
        resolved = found if resolved is None else resolved.unionByName(found)
    return resolved.select(*keys, F.shiftright("rank", 1).alias(order), (F.col("rank") % 2 == 1).alias("is_put"), *[F.col(f"image.{c}").alias(c) for c in images])


def current_state(feed: DataFrame, keys: list[str], order: str, is_put: Column, images: list[str] | None = None, base: DataFrame | None = None, batches: int = BATCHES) -> DataFrame:
    """(keys, order, images): the live rows after all changes; rows of ``base`` (same columns) whose keys the feed does not touch stay."""
    images = images or []
    resolved = resolve_newest_first(feed, keys, order, is_put, images, batches)
    live = resolved.where("is_put").drop("is_put")
    if base is None:
        return live
    base = base.select(*keys, order, *images)
    return live.unionByName(null_safe_join(base, resolved.hint("merge"), keys, "left_anti"))


def live_keys(kv_log: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(db_id, cf, user_key, seqno) of the keys whose last put or delete is a put; rows without a key change nothing."""
    ops = kv_log.where(F.col("tp").isin(0, 1, 4, 5) & F.col("user_key").isNotNull())
    return current_state(ops, ["db_id", "cf", "user_key"], "seqno", F.col("tp").isin(1, 5), batches=batches)


def live_files(edits: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(db_id, file_number, edit_no, cf, file_level): files whose last ADD_FILE or DEL_FILE is an ADD_FILE, as in that change."""
    changes = edits.where(F.col("kind").isin("ADD_FILE", "DEL_FILE") & F.col("packed_number_and_path_id").isNotNull())
    changes = changes.withColumn("file_number", file_number("packed_number_and_path_id"))
    return current_state(changes, ["db_id", "file_number"], "edit_no", F.col("kind") == "ADD_FILE", ["cf", "file_level"], batches=batches)
