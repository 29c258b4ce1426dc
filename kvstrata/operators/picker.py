"""Level sizing, compaction scores and the choice of compaction inputs, from file metadata.

``files`` has the columns of FILE_SCHEMA and a group column (a database, a family
or both in one); every group is sized and scored on its own, all groups in one
job.  Level sizes are folded to one row per group, and the sizing rule is a few
native expressions over it.  A level without a limit has a null target."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.operators.ordering import blocked_sums, in_ranges


@dataclass(frozen=True)
class LevelOptions:
    """Sizing options with the engine's usual defaults."""

    max_level: int = 7
    base_bytes: int = 256 << 20
    multiplier: float = 10.0
    level0_trigger: int = 4


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def _at(level: Column, by_level: dict[int, Column]) -> Column:
    """The value that belongs to a level."""
    return reduce(lambda rest, item: F.when(level == item[0], item[1]).otherwise(rest), by_level.items(), F.lit(None))


def _level_sums(files: DataFrame, group: str, levels: range) -> DataFrame:
    """One row per group: n, b, idle (files, bytes, and bytes of idle files) of every level, and whether level 0 is busy."""
    busy = F.coalesce("being_compacted", F.lit(False))
    size = F.coalesce("file_size", F.lit(0))
    sums = [F.max((F.col("level") == 0) & busy).alias("busy0")]
    for i in levels:
        here = F.col("level") == i
        sums += [F.count_if(here).alias(f"n{i}"), F.sum(F.when(here, size).otherwise(0)).alias(f"b{i}"), F.sum(F.when(here & ~busy, size).otherwise(0)).alias(f"idle{i}")]
    return files.where("level IS NOT NULL").groupBy(group).agg(*sums)


def size_levels(sums: DataFrame, o: LevelOptions) -> DataFrame:
    """``sums`` with base_level, factor, and target1.. per level; columns n0, b0, b1.. are sizes of levels.

    The largest level, divided by the multiplier once for each level above the deepest, gives
    every level a shrunken size.  The base level is the lowest one, not below the
    first that holds data, whose shrunken size fits under the ceiling (level 0 or the
    base size, whichever is larger), or the first level if none does; from there the
    targets grow by one factor up to the largest level."""
    deepest = o.max_level - 1
    levels = range(1, o.max_level)
    top = F.least(*[F.when(F.col(f"b{i}") > 0, i) for i in levels], F.lit(None).cast("int"))
    out = sums.withColumn("_largest", F.greatest(*[F.col(f"b{i}") for i in levels], F.lit(0).cast("long"))).withColumn("_top", top).withColumn("_ceiling", F.greatest("b0", F.lit(o.base_bytes)))
    out = out.withColumn(f"_s{deepest}", F.col("_largest"))
    for i in range(deepest - 1, 0, -1):
        out = out.withColumn(f"_s{i}", _rounded(F.col(f"_s{i + 1}") / F.lit(float(o.multiplier))))
    shrunken = {i: F.col(f"_s{i}") for i in levels}
    fits = [F.when((F.col("_top") >= i) & (shrunken[i] <= F.col("_ceiling")), i) for i in levels]
    out = out.withColumn("_fit", F.coalesce(F.greatest(*fits, F.lit(None).cast("int")), F.lit(1))).withColumn("_floor", _rounded(F.col("_ceiling") / F.lit(float(o.multiplier))))
    low = _at(F.col("_top"), shrunken) <= F.col("_floor")  # little data: stay where it begins
    out = out.withColumn("_base", F.when(low, F.col("_top")).otherwise(F.col("_fit")))
    start = F.when(low, F.col("_floor") + 1).otherwise(F.least(_at(F.col("_fit"), shrunken), F.col("_ceiling")))
    crowded = (F.col("b0") > F.col("_start")) & ((F.col("b0") > o.base_bytes) | (F.floor(F.col("n0") / 2) > o.level0_trigger))
    out = out.withColumn("_start", start).withColumn("_start", F.when(crowded, F.col("b0")).otherwise(F.col("_start")))
    empty = F.col("_largest") == 0
    growth = F.pow(F.col("_largest") / F.col("_start"), F.lit(1.0) / (deepest - F.col("_base")))
    out = out.withColumn("base_level", F.when(empty, deepest).otherwise(F.col("_base"))).withColumn("factor", F.when(empty | (F.col("_base") == deepest), 1.0).otherwise(growth))
    for i in levels:
        grown = F.when(F.col("_base") < i, _rounded(F.col(f"_t{i - 1}") * F.col("factor"))) if i > 1 else F.lit(None)
        out = out.withColumn(f"_t{i}", F.when(~empty, F.when(F.col("_base") == i, F.col("_start")).otherwise(grown)))
    for i in levels:
        out = out.withColumn(f"target{i}", F.when(F.col(f"_t{i}").isNotNull(), F.greatest(f"_t{i}", "_ceiling")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def level_scores(files: DataFrame, group: str, options: LevelOptions) -> DataFrame:
    """(group, level, base_level, factor, target, n_files, n_bytes, score) for levels 0..max_level - 1; the last level, and a busy level 0, have no score."""
    deepest = options.max_level - 1
    sized = size_levels(_level_sums(files, group, range(options.max_level)), options)
    low = _at(F.col("base_level"), {i: F.col(f"target{i}") for i in range(1, options.max_level)})
    limit = F.greatest(F.lit(options.base_bytes), _rounded(low / F.col("factor")))
    by_bytes = F.when(low.isNotNull(), F.col("b0") / limit).otherwise(0.0)
    rows = []
    for i in range(options.max_level):
        target = F.col(f"target{i}") if i else F.lit(None).cast("long")
        if i == 0:
            score = F.when(~F.col("busy0"), F.greatest(F.col("n0") / options.level0_trigger, by_bytes))
        else:
            score = F.lit(None).cast("double") if i == deepest else F.coalesce(F.try_divide(F.col(f"idle{i}"), target), F.lit(0.0))
        rows.append(F.struct(F.lit(i).alias("level"), "base_level", "factor", target.alias("target"), F.col(f"n{i}").alias("n_files"), F.col(f"b{i}").alias("n_bytes"), score.cast("double").alias("score")))
    return sized.select(group, F.explode(F.array(*rows)).alias("x")).select(group, "x.*")


def pick_level(scores: DataFrame, group: str) -> DataFrame:
    """(group, level, output_level, score): the level with the highest score of at least 1; ties go to the lower level."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "level")
    best = scores.where("score IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1 AND score >= 1")
    return best.select(group, "level", F.when(F.col("level") == 0, F.col("base_level")).otherwise(F.col("level") + 1).cast("int").alias("output_level"), "score")


def overlap_totals(left: DataFrame, right: DataFrame, group: list[str], ranges: int | None = None) -> DataFrame:
    """``left`` (group, id, smallest, largest, ...) with n_overlap, overlap_bytes and overlap_busy over the files of ``right`` whose key ranges meet its own.

    A range meets all ranges that begin at or before its end, less those that end
    before its begin; both are running totals in key order, so no pair of files
    is ever made.  The order is cut into ``ranges`` of about equal size (as many as
    shuffles have partitions, unless told).  Files without bounds, or with a null in the group, meet none."""
    null = F.lit(None)
    busy = F.coalesce("being_compacted", F.lit(False)).cast("long")
    bounded = right.where("smallest IS NOT NULL AND largest IS NOT NULL")
    size = F.coalesce("file_size", F.lit(0)).cast("long")

    def marks(key: str, kind: int) -> DataFrame:
        return bounded.select(*group, F.col(key).alias("k"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"), size.alias("b"), busy.alias("busy"), null.cast("long").alias("file_id"))

    def asks(key: str, kind: int) -> DataFrame:
        zero = F.lit(0).cast("long")
        return left.select(*group, F.col(key).alias("k"), F.lit(kind).alias("kind"), zero.alias("n"), zero.alias("b"), zero.alias("busy"), "file_id").where("k IS NOT NULL")

    def totals(marked: DataFrame, asked: DataFrame, suffix: str) -> DataFrame:
        run = blocked_sums(in_ranges(marked.unionByName(asked), [*group, "k", "kind"], ranges), group, F.col("_range"), ["k", "kind"], ["n", "b", "busy"])
        return run.where("file_id IS NOT NULL").select(*group, "file_id", *[F.col(f"run_{c}").alias(f"{c}_{suffix}") for c in ("n", "b", "busy")])

    begun = totals(marks("smallest", 0), asks("largest", 1), "begun")
    ended = totals(marks("largest", 1), asks("smallest", 0), "ended")
    keys = [*group, "file_id"]
    both = left.join(begun, keys, "left").join(ended, keys, "left")
    for c, out in (("n", "n_overlap"), ("b", "overlap_bytes"), ("busy", "overlap_busy")):
        both = both.withColumn(out, F.coalesce(F.col(f"{c}_begun") - F.col(f"{c}_ended"), F.lit(0)).cast("long")).drop(f"{c}_begun", f"{c}_ended")
    return both


def pick_files(files: DataFrame, picked: DataFrame, group: str) -> DataFrame:
    """The files of the picked level that a compaction starts from: of level 0 all, of others the idle one with the least integer ratio of overlapped bytes to its size whose overlapped files are idle."""
    here = files.join(picked.select(group, F.col("level").alias("from_level"), "output_level"), group)
    zero = here.where("from_level = 0 AND level = 0")
    inputs = here.where("from_level > 0 AND level = from_level AND NOT coalesce(being_compacted, false) AND file_size > 0")
    below = here.where("from_level > 0 AND level = from_level + 1")
    scored = overlap_totals(inputs, below, [group]).where("overlap_busy = 0")
    w = Window.partitionBy(group).orderBy(F.expr("overlap_bytes DIV file_size"), "file_id")
    one = scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(zero.columns)
    return zero.unionByName(one)


def expand_inputs(files: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """(group, file_id, level, output_level): the chosen files and the files of the output level they meet; none if one of those is busy."""
    span = chosen.groupBy(group, "output_level").agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    met = files.join(span, group).where((F.col("level") == F.col("output_level")) & (F.col("smallest") <= F.col("hi")) & (F.col("largest") >= F.col("lo")))
    blocked = met.where("coalesce(being_compacted, false)").select(group).distinct()
    both = chosen.select(group, "file_id", "level", "output_level").unionByName(met.select(group, "file_id", "level", "output_level")).distinct()
    return both.join(blocked, group, "left_anti")
