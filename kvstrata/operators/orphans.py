"""References to records that do not exist at the moment of the reference.

Method: skew-aware split.  References are first folded to one row per key and
period (map-side, so a hot key sends a few rows per task): their number and the
first and last point.  These groups meet the life spans of their keys.  A group
that lies within one span has no orphan, one that meets no span is all orphans,
and only the references of the others, which a span begins or ends among, are
looked at one by one.  Keys are split by the comparisons they cause: a key with
more than 1/``PARTS`` of them all is heavy, so there are fewer than ``PARTS`` heavy
keys whatever the data are.  Their spans, cut into blocks of positions, are
broadcast if they are counted to be few, else references and spans of heavy keys
are shuffled by key and block, so that a heavy key is many tasks either way; all
other keys go through a shuffled anti join.  The orphans of all branches are united.

A record lives in spans [start, end) of positions.  Positions are doubled, so
that a reference "just before n" (2n - 1) and one "after n" (2n) are both plain
numbers and all branches make one comparison.

Defined results: references with a null key, scope or position name nothing and
are not reported; a null period is a period of its own; repeated rows of a
change or block count once (of unlike repeats the greatest row holds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.operators.changes import null_safe_join
from kvstrata.operators.skew import spread_join, thinned
from kvstrata.sources.scratch import durable
from kvstrata.sources.tables import file_number

#: A key that causes more than 1 / PARTS of all comparisons is heavy.
PARTS = 1024
#: Rows (five longs) of heavy spans that are broadcast, some 10 MB; beyond, they are shuffled by key and block.
BROADCAST_SPANS = 200_000
#: Doubled positions in a block of a heavy key, which bounds the spans that one reference is compared with.
BLOCK = 1 << 10
#: Positions in a block within which the next event of a key is looked for.
EVENT_BLOCK = 1 << 16
END = (1 << 62) - 1

KEY = ["domain", "scope", "key"]
GROUP = ["ref_table", "ref_field", *KEY, "period"]


def life_spans(events: DataFrame, width: int = EVENT_BLOCK) -> DataFrame:
    """(KEY, start, end) from events (KEY, pos, is_add): from an add to the next event of the key.

    The next event is looked for in the same block of ``width`` positions, then in the
    key's next block that has any, so the events of a hot key are many tasks."""
    known = events.where("scope IS NOT NULL AND key IS NOT NULL AND pos IS NOT NULL").select(*KEY, "pos", "is_add", F.floor(F.col("pos") / width).alias("block"))
    inside = known.withColumn("after", F.lead("pos").over(Window.partitionBy(*KEY, "block").orderBy("pos")))
    firsts = known.groupBy(*KEY, "block").agg(F.min("pos").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy(*KEY).orderBy("block"))).where("later IS NOT NULL").drop("first")
    spans = inside.where("is_add").join(later.hint("merge"), [*KEY, "block"], "left")
    return spans.select(*KEY, (F.col("pos") * 2).alias("start"), F.coalesce(F.coalesce("after", "later") * 2, F.lit(END)).alias("end"))


def reference_loads(refs: DataFrame) -> DataFrame:
    """(GROUP, n, lo, hi): references per key and period, with their first and last point."""
    return refs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("point").alias("lo"), F.max("point").alias("hi"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = left[keys[0]] == right[keys[0]]
    for k in keys[1:]:
        on = on & (left[k] == right[k])
    return on


def _blocks(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK))


def _missing(rows: DataFrame, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """The ``rows`` (KEY, lo, hi) of the shuffled branch that meet none of the spans of their key."""
    meets = (F.col("start") <= F.col(hi)) & (F.col("end") > F.col(lo))
    return rows.join(spans.hint("merge"), _same(rows, spans, KEY) & meets, "left_anti")


class Lookup:
    """Life spans of the keys that ``loads`` refer to, split into heavy and light keys."""

    def __init__(self, loads: DataFrame, spans: DataFrame, parts: int = PARTS, broadcast_spans: int = BROADCAST_SPANS):
        self.spans, self.most = spans, broadcast_spans
        held = spans.groupBy(*KEY).agg(F.count("*").alias("spans"))
        refs = loads.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("hi").alias("top"))
        work = durable(refs.join(held.hint("merge"), KEY, "left").withColumn("work", F.col("n") * F.greatest(F.lit(1), F.coalesce("spans", F.lit(0)))))
        total = work.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
        #: Fewer than ``parts`` rows.
        self.heavy = durable(work.where(F.col("work") > total // parts).select(*KEY, "top"))
        self.blocks = self._heavy_blocks()

    def _heavy_blocks(self) -> DataFrame:
        """(KEY, block, spans): the spans of heavy keys in each block of positions that they meet, in order; ends beyond the last reference are cut off."""
        hot = self.spans.join(F.broadcast(self.heavy), KEY).where(F.col("start") <= F.col("top"))
        cut = hot.withColumn("block", F.explode(_blocks(F.col("start"), F.least(F.col("end") - 1, F.col("top")))))
        stored = durable(cut.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))  # at most BLOCK / 2 + 1 spans
        few = stored.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= self.most
        return stored.hint("broadcast" if few else "merge")

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of heavy keys, rows of all other keys)."""
        keys = F.broadcast(self.heavy.select(*KEY))
        return rows.join(keys, KEY, "left_semi"), rows.join(keys, KEY, "left_anti")

    def missing(self, refs: DataFrame) -> DataFrame:
        """The references (KEY, point) that no span of their key holds."""
        hot, cold = self.split(refs)
        at = hot.withColumn("_block", F.floor(F.col("point") / BLOCK))
        blocks = self.blocks.withColumnRenamed("block", "_block")
        held = F.exists("spans", lambda s: (F.col("point") >= s["start"]) & (F.col("point") < s["end"]))
        lost = at.join(blocks, [*KEY, "_block"], "left").where(~F.coalesce(held, F.lit(False))).select(refs.columns)
        return lost.unionByName(_missing(cold, self.spans, "point", "point"))

    def groups(self, loads: DataFrame) -> DataFrame:
        """(GROUP, n, state) of the groups that have orphans: ``all`` where no span is met, ``some`` where one begins or ends among the references."""
        whole = (F.col("start") <= F.col("lo")) & (F.col("end") > F.col("hi"))
        open_groups = loads.join(self.spans.hint("merge"), _same(loads, self.spans, KEY) & whole, "left_anti")
        stored = durable(open_groups)
        none = durable(_missing(stored, self.spans, "lo", "hi").select(*GROUP))
        marked = null_safe_join(stored, none.withColumn("lost", F.lit(True)).hint("merge"), GROUP, "left")
        return marked.select(*GROUP, "n", F.when(F.col("lost"), "all").otherwise("some").alias("state"))


def _resolved(refs: DataFrame, spans: DataFrame, parts: int, broadcast_spans: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(loads, groups with orphans, references of groups that are orphans throughout, orphans among the references of the others)."""
    refs = durable(refs.where("scope IS NOT NULL AND key IS NOT NULL AND point IS NOT NULL"))
    spans = durable(spans)
    loads = durable(reference_loads(refs))
    lookup = Lookup(loads, spans, parts, broadcast_spans)
    groups = durable(lookup.groups(loads))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = F.xxhash64(*GROUP)
    found = durable(spread_join(durable(thinned(refs, named, groups, named, groups.count())), groups, GROUP, "n", total, null_safe=True))
    return loads, groups, found.where("state = 'all'").drop("state"), lookup.missing(found.where("state = 'some'").drop("state"))


def orphans(refs: DataFrame, spans: DataFrame, parts: int = PARTS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """The rows of refs (ref_table, ref_field, KEY, point, ref_no, period) whose key has no span around the point."""
    _, _, throughout, single = _resolved(refs, spans, parts, broadcast_spans)
    return throughout.unionByName(single)


def manifest_references(edits: DataFrame, filter_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and record events of a manifest, in the forms ``orphans`` and ``life_spans`` take."""
    packed = ["kind", "cf", "packed_number_and_path_id", "edit_ts"]
    changes = edits.where("db_id IS NOT NULL AND edit_no IS NOT NULL").groupBy("db_id", "edit_no").agg(F.max(F.struct(*packed)).alias("c")).select("db_id", "edit_no", "c.*")
    changes = durable(changes.withColumn("file", file_number("packed_number_and_path_id")).withColumn("period", F.date_format("edit_ts", "yyyy-MM")))
    files = changes.where(F.col("kind").isin("ADD_FILE", "DEL_FILE"))
    families = changes.where(F.col("kind").isin("ADD_CF", "DROP_CF"))

    def key(domain: str, scope: str, column: str) -> list:
        return [F.lit(domain).alias("domain"), F.col(scope).cast("int").alias("scope"), F.col(column).cast("long").alias("key")]

    events = files.select(*key("file", "db_id", "file"), F.col("edit_no").alias("pos"), (F.col("kind") == "ADD_FILE").alias("is_add")).unionByName(
        families.select(*key("cf", "db_id", "cf"), F.col("edit_no").alias("pos"), (F.col("kind") == "ADD_CF").alias("is_add"))
    )

    def refs(rows: DataFrame, table: str, field: str, domain: str, column: str, no: str, point) -> DataFrame:
        return rows.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), *key(domain, "db_id", column), point.alias("point"), F.col(no).alias("ref_no"), "period")

    before = F.col("edit_no") * 2 - 1
    deleted = refs(changes.where("kind = 'DEL_FILE'"), "edits", "deleted_files", "file", "file", "edit_no", before)
    family = refs(changes.where("kind <> 'ADD_CF' AND cf <> 0"), "edits", "column_family", "cf", "cf", "edit_no", before)
    blocks = filter_blocks.groupBy("block_no").agg(F.max(F.struct("db_id", "packed_number_and_path_id", "edit_no", "built_at")).alias("b")).select("block_no", "b.*")
    blocks = blocks.withColumn("file", file_number("packed_number_and_path_id")).withColumn("period", F.date_format("built_at", "yyyy-MM"))
    named = refs(blocks, "filter_blocks", "packed_number_and_path_id", "file", "file", "block_no", F.col("edit_no") * 2)
    return deleted.unionByName(family).unionByName(named), events


def orphan_counts(refs: DataFrame, spans: DataFrame, parts: int = PARTS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """(ref_table, ref_field, period, n_refs, n_orphans): the report per table and period; groups that are orphans throughout are counted without their references."""
    by = ["ref_table", "ref_field", "period"]
    loads, groups, _, single = _resolved(refs, spans, parts, broadcast_spans)
    lost = groups.where("state = 'all'").select(*by, "n").unionByName(reference_loads(single).select(*by, "n"))
    missing = lost.groupBy(*by).agg(F.sum("n").alias("n_orphans"))
    total = loads.groupBy(*by).agg(F.sum("n").alias("n_refs"))
    return null_safe_join(total, missing, by, "left").select(*by, "n_refs", F.coalesce("n_orphans", F.lit(0).cast("long")).alias("n_orphans"))
