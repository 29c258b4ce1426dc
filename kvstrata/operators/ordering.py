"""Running totals and ranks over a whole table without one task that holds it all.

Rows are put into buckets that follow from their order value alone or are stored
with them, so the two passes (totals per bucket, rows within a bucket) agree however
tasks are retried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.operators.changes import null_safe_join
from kvstrata.sources.scratch import durable


def blocked_sums(df: DataFrame, group: list[str], block: Column, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``run_<v>`` for each value column: its sum over the group's rows up to this one (and its equals in order).

    ``block`` must not fall as the order rises.  Rows are summed within their block
    and blocks among themselves, so a hot group is many tasks.  Nulls in the group
    are equal; rows with a null block are left out."""
    blocked = df.withColumn("_block", block).where("_block IS NOT NULL")
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block")
    sums = blocked.groupBy(*group, "_block").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = sums.select(*group, "_block", *[(F.sum(f"_sum_{v}").over(across) - F.col(f"_sum_{v}")).alias(f"_before_{v}") for v in values])
    for v in values:
        blocked = blocked.withColumn(f"_inside_{v}", F.sum(v).over(inside))
    out = null_safe_join(blocked, before.hint("merge"), [*group, "_block"], "inner") if group else blocked.join(before.hint("merge"), "_block")
    return out.select(*df.columns, *[(F.col(f"_inside_{v}") + F.col(f"_before_{v}")).cast("long").alias(f"run_{v}") for v in values])


def running_total(df: DataFrame, order: str, value: Column, out: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to this one in order of the unique long column ``order`` (itself included)."""
    summed = blocked_sums(df.withColumn("_value", value), [], F.floor(F.col(order) / width), [order], ["_value"])
    return summed.withColumnRenamed("run__value", out).drop("_value")


def in_ranges(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of the range of ``columns`` that a row lies in; ranges follow from quantiles of a sample and hold about equally many rows.

    Equal values lie in one range.  The rows are stored with their range, as another
    sample would draw other limits."""
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return durable(dealt.withColumn("_range", F.spark_partition_id()))


def key_ranks(df: DataFrame, group: list[str], key: str, out: str = "key_rank", ranges: int | None = None) -> DataFrame:
    """``df`` with the rank (from 0) of each distinct key within its group, in byte order.

    Keys are counted in ranges of about equal size, whatever prefixes they share."""
    keys = in_ranges(durable(df.select(*group, key).distinct()), [*group, key], ranges)
    sizes = keys.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).drop("_n")
    inside = keys.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key)))
    ranks = inside.join(before.hint("merge"), [*group, "_range"]).select(*group, key, (F.col("_before") + F.col("_at") - 1).cast("long").alias(out))
    return df.join(ranks.hint("merge"), [*group, key])
