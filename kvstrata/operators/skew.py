"""Joins that keep hot keys apart and thin their rows before the shuffle, with broadcasts of a proven bound.

Of ``total`` rows, fewer than ``PARTS`` keys can have more than ``total / PARTS``
each.  So the facts of the hot keys are a table of fewer than ``PARTS`` rows
whatever the data are, and may be broadcast; all other keys are shuffled, and
none of them makes a task much larger than a fair share.

A bitmap of key hashes has at most ``MOST_BITS`` bits however many keys it is made
of, so it may be broadcast, too.  Rows whose bit is not set have none of the keys
and need not be shuffled; the join itself stays exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024
#: Bits for each key, and the most there are: 16 MB.
BITS_PER_KEY, MOST_BITS = 32, 1 << 27
#: Bits of one row of a bitmap (a fixed value of bitmap_construct_agg).
ROW_BITS = 1 << 15


def _on(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> tuple[DataFrame, Column]:
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return renamed, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) if null_safe else F.col(k) == F.col(f"_right_{k}") for k in keys])


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], load: str, total: int, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key and in ``load`` the number of rows of that key, out of ``total``.

    ``how`` is inner or left; ``load`` is not kept.  Both sides are read twice, so they
    should be stored tables."""
    share = F.col(load) > total // PARTS
    names = [f"_right_{k}" for k in keys]
    hot, on = _on(rows, facts.where(share).drop(load), keys, null_safe)
    cold, _ = _on(rows, facts.where(~share).drop(load), keys, null_safe)
    warm = rows.join(F.broadcast(hot), on, "inner").drop(*names)
    rest = rows.join(F.broadcast(hot.select(*names)), on, "left_anti")
    return warm.unionByName(rest.join(cold.hint("merge"), on, how).drop(*names))


def bitmap(wanted: DataFrame, key: Column, n: int) -> tuple[DataFrame, int]:
    """((_row, _bits), number of bits): which hashes of ``key`` occur among some ``n`` rows."""
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (max(1, n) * BITS_PER_KEY - 1).bit_length()))
    place = wanted.select(F.pmod(key, F.lit(bits)).alias("_h"))
    return place.groupBy(F.shiftright("_h", 15).alias("_row")).agg(F.bitmap_construct_agg(F.col("_h").bitwiseAND(F.lit(ROW_BITS - 1))).alias("_bits")), bits


def may_be_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int, out: str = "_may") -> DataFrame:
    """``rows`` with a column that is false where ``key`` (a long hash) is surely not among the ``n`` ``wanted`` ones; null keys are in nothing."""
    rows_of_bits, bits = bitmap(wanted, wanted_key, n)
    at = F.pmod(key, F.lit(bits))
    marked = rows.withColumn("_at", at).withColumn("_of", F.shiftright("_at", 15))
    joined = marked.join(F.broadcast(rows_of_bits), F.col("_of") == F.col("_row"), "left")
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST((_at & 32767) DIV 8 + 1 AS INT), 1)), 16, 10) AS INT)")
    bit = F.expr("CAST(_at & 7 AS INT)")
    return joined.withColumn(out, F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("_at", "_of", "_row", "_bits")


def thinned(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int) -> DataFrame:
    """``rows`` without those whose ``key`` is surely not among the ``wanted`` ones."""
    return may_be_in(rows, key, wanted, wanted_key, n).where("_may").drop("_may")
