"""Only the records that are new or changed since the last successful run.

Method: a Merkle tree over key ranges.  A leaf is a range of keys of one part of
the data; its digest covers all its rows.  Digests are folded map-side, so only
one row per leaf is shuffled; the digest of an inner node is folded from those of
its leaves.  ``IncrementalTable`` keeps the tree of the last published run.  A run
makes the tree of the data as it is and compares it with the saved one from the
root down: only below nodes that differ are children looked at, where nothing
differs the descent ends, and only rows of leaves that differ are read further
and compared with the records saved for these leaves.

Output and tree of a run are written beside those of the run before, and one
rename of a pointer file publishes both.  So a run that fails leaves the earlier
state in force, and its records come again in the next run.  What a run writes
follows the change: records are saved for its changed leaves only, and the tree
tells for every leaf which version holds its records.

Where earlier runs kept no tree but a ledger of positions, ``adopt`` publishes
the tree and records of the rows that the ledger says are done as the first
version.

Defined results: null keys form a leaf of their own (-1); repeated rows count in
the digest, so dropping a repeat is a change of the leaf but yields no changed
record; a null database, family or log number, and a null sequence number in the
log that was reached, is covered by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.operators.changes import null_safe_join
from kvstrata.operators.skew import thinned
from kvstrata.sources.pointer import Pointer
from kvstrata.sources.scratch import bounded_broadcast, durable

FANOUT_BITS = 5
#: Covered positions, of four numbers each, that may be broadcast (some 10 MB).
BROADCAST_ROWS = 200_000

_TREE = "part long, level int, node long, digest long, at int"


def leaf_digests(rows: DataFrame, part: str, leaf: str, row_hash: Column) -> DataFrame:
    """(part, leaf, digest) of rows."""
    folded = rows.groupBy(part, leaf).agg(F.count(row_hash).alias("n"), F.bit_xor(row_hash).alias("x"), F.sum(row_hash.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    return folded.select(F.col(part).alias("part"), F.col(leaf).alias("leaf"), F.xxhash64("n", F.coalesce("x", F.lit(0)), F.coalesce("s", F.lit(0))).alias("digest"))


def tree_of(leaves: DataFrame) -> DataFrame:
    """(part, level, node, digest): the whole tree over leaves (part, leaf, digest), in one pass; level 0 are the leaves."""
    top = leaves.agg(F.max("leaf")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // FANOUT_BITS))
    each = leaves.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, levels + 1)])))
    h = F.xxhash64("leaf", "digest")
    up = each.groupBy("part", "level", F.expr(f"shiftright(leaf, level * {FANOUT_BITS})").alias("node"))
    inner = up.agg(F.xxhash64(F.count(h), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("digest"))
    return leaves.select("part", F.lit(0).alias("level"), F.col("leaf").alias("node"), "digest").unionByName(inner.select("part", "level", "node", "digest"))


def changed_leaves(current: DataFrame, saved: DataFrame) -> tuple[DataFrame, list[int]]:
    """The leaves (part, leaf) that differ between two stored trees (part, level, node, digest), found by descent from the root, and the levels that were compared."""
    top = max(x.agg(F.max("level")).first()[0] or 0 for x in (current, saved))
    open_nodes: DataFrame | None = None
    looked = []
    for level in range(top, -1, -1):
        now, then = (x.where(F.col("level") == level) for x in (current, saved))
        if open_nodes is not None:
            keep = open_nodes.select(F.col("part").alias("_p"), F.col("node").alias("_up"))
            now, then = (x.join(keep.hint("merge"), (x.part == F.col("_p")) & (F.shiftright(x.node, FANOUT_BITS) == F.col("_up")), "left_semi") for x in (now, then))
        then = then.select(F.col("part").alias("p2"), F.col("node").alias("n2"), F.col("digest").alias("d2"))
        both = now.select("part", "node", "digest").join(then.hint("merge"), (F.col("part") == F.col("p2")) & (F.col("node") == F.col("n2")), "full_outer")
        open_nodes = durable(both.where(~F.col("digest").eqNullSafe(F.col("d2"))).select(F.coalesce("part", "p2").alias("part"), F.coalesce("node", "n2").alias("node")))
        looked.append(level)
        if open_nodes.isEmpty():
            break
    return open_nodes.withColumnRenamed("node", "leaf"), looked


def covered_positions(ingest_runs: DataFrame) -> DataFrame:
    """(db_id, cf, log, seq): the highest position that a succeeded run of a database and family reached.

    A run counts by its latest report (of reports at one time, the one with the
    greatest report_no); without surrounding blanks and case, that must say
    ``succeeded``, and its position must not be null."""
    report = F.struct("reported_at", "report_no", "status", "log_number", "last_sequence")
    last = ingest_runs.groupBy("run_no", "db_id", "cf").agg(F.max(report).alias("r"))
    done = last.where(F.lower(F.regexp_replace("r.status", r"^\s+|\s+$", "")).eqNullSafe("succeeded") & F.col("r.log_number").isNotNull() & F.col("r.last_sequence").isNotNull())
    return done.groupBy("db_id", "cf").agg(F.max(F.struct(F.col("r.log_number").alias("log"), F.col("r.last_sequence").alias("seq"))).alias("p")).select("db_id", "cf", "p.log", "p.seq")


def covered_rows(rows: DataFrame, covered: DataFrame, log: str, seq: str) -> DataFrame:
    """The rows (db_id, cf, log, seq, ...) at or below the covered position of their database and family; ``covered`` should be a stored table."""
    done = covered.select(F.col("db_id").alias("_db"), F.col("cf").alias("_cf"), F.col("log").alias("_log"), F.col("seq").alias("_seq"))
    done = bounded_broadcast(done, covered.count(), BROADCAST_ROWS)
    below = (F.col(log) < F.col("_log")) | ((F.col(log) == F.col("_log")) & (F.col(seq) <= F.col("_seq")))
    return rows.join(done, (F.col("db_id") == F.col("_db")) & (F.col("cf") == F.col("_cf"))).where(below).drop("_db", "_cf", "_log", "_seq")


class IncrementalTable:
    """State of an incremental consumer in a shared folder: ``versions/N/{output,tree}``, ``records/at=N`` and the pointer ``CURRENT``.

    ``key`` identifies a record.  ``range_of`` is a long Column over the key that
    orders records into leaves of ``leaf_width`` values, ``part`` a long Column over
    the key that says which subtree a record belongs to.  With ``by_key`` a record
    whose key was saved is done, whatever else its rows hold; otherwise it comes
    again when any column has changed, and keys that are gone are reported."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], range_of: Column, leaf_width: int = 1024, part: Column | None = None, by_key: bool = False):
        self.spark, self.root, self.key, self.by_key = spark, root.rstrip("/"), key, by_key
        self._leaf = F.coalesce(F.floor(range_of / leaf_width).cast("long"), F.lit(-1).cast("long"))
        self._part = F.lit(0).cast("long") if part is None else part
        self._pointer = Pointer(spark, f"{self.root}/CURRENT")
        #: Levels of the tree that the last run compared, from the top; 0 are the leaves.
        self.levels_read: list[int] = []

    def version(self) -> int:
        """Number of the published version; 0 before the first run."""
        return (self._pointer.read() or {"version": 0})["version"]

    def _saved_tree(self, at: int) -> DataFrame:
        return self.spark.read.schema(_TREE).parquet(f"{self.root}/versions/{at}/tree") if at else self.spark.createDataFrame([], _TREE)

    def _marked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", self._part).withColumn("_leaf", self._leaf).withColumn("_hash", F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in rows.columns]))

    def _placed(self, rows: DataFrame, open_leaves: DataFrame, n: int) -> DataFrame:
        """The rows of open leaves, and of a few others whose bit is set by chance (for saved and new rows alike, so they compare as equal)."""
        return thinned(rows, F.xxhash64("_part", "_leaf"), open_leaves, F.xxhash64("part", "leaf"), n)

    def _saved_records(self, at: int, saved: DataFrame, open_leaves: DataFrame, n: int) -> DataFrame:
        """The records that the published version holds for the open leaves: (key, _hash)."""
        leaves = saved.where("level = 0")
        versions = [r[0] for r in leaves.select("at").distinct().collect()]  # one number per published version at most
        if not versions:
            return self.spark.createDataFrame([], self._record_schema)
        records = self.spark.read.schema(self._record_schema + ", at int").option("basePath", f"{self.root}/records").parquet(*[f"{self.root}/records/at={v}" for v in versions])
        held = self._placed(records.withColumn("_part", self._part).withColumn("_leaf", self._leaf), open_leaves, n)
        if versions != [1]:  # a leaf that was saved again leaves older records behind
            now = leaves.select(F.col("part").alias("_p"), F.col("node").alias("_n"), F.col("at").alias("_a"))
            held = held.join(now.hint("merge"), (F.col("_part") == F.col("_p")) & (F.col("_leaf") == F.col("_n")) & (F.col("at") == F.col("_a")), "left_semi")
        return held.select(*self.key, *([] if self.by_key else ["_hash"]))

    def _publish(self, at: int, now: DataFrame, tree: DataFrame, saved: DataFrame, open_leaves: DataFrame) -> None:
        """Save the records of the open leaves and the tree, then rename."""
        cols = [*self.key, *([] if self.by_key else ["_hash"])]
        now.select(cols).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/records/at={at}")
        before = saved.where("level = 0").select(F.col("part").alias("_p"), F.col("node").alias("_n"), F.col("at").alias("_at"))
        fresh = open_leaves.select(F.col("part").alias("_p"), F.col("leaf").alias("_n"), F.lit(at).alias("_new"))
        same = (F.col("part") == F.col("_p")) & (F.col("node") == F.col("_n"))
        leaves = tree.where("level = 0").join(before.hint("merge"), same, "left").drop("_p", "_n").join(fresh.hint("merge"), same, "left")
        marked = leaves.select("part", "level", "node", "digest", F.coalesce("_new", "_at", F.lit(at)).cast("int").alias("at"))
        whole = marked.unionByName(tree.where("level > 0").withColumn("at", F.lit(None).cast("int")))
        whole.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/versions/{at}/tree")
        self._pointer.publish({"version": at})

    def _describe(self, rows: DataFrame) -> None:
        kinds = dict(rows.dtypes)
        self._record_schema = ", ".join(f"`{k}` {kinds[k]}" for k in self.key) + ("" if self.by_key else ", _hash long")

    def adopt(self, rows: DataFrame) -> None:
        """Publish the state in which ``rows`` are done, as earlier runs without a tree left it; the first version, without output."""
        if self.version():
            raise ValueError("there is a published version")
        self._describe(rows)
        marked = self._marked(rows)
        leaves = durable(leaf_digests(marked, "_part", "_leaf", F.col("_hash")))
        none = leaves.select("part", "leaf").limit(0)
        self._publish(1, marked, tree_of(leaves), self._saved_tree(0), none)

    def run(self, rows: DataFrame, publish: bool = True) -> DataFrame:
        """Records of ``rows`` that are new or changed, with column ``_change`` (upsert, or delete for keys that are gone); published with the tree unless told not to."""
        self._describe(rows)
        at = self.version()
        saved = self._saved_tree(at)
        marked = self._marked(rows)
        tree = durable(tree_of(durable(leaf_digests(marked, "_part", "_leaf", F.col("_hash")))))
        open_leaves, self.levels_read = changed_leaves(tree, saved)
        n = open_leaves.count()
        now = durable(self._placed(marked, open_leaves, n).drop("_part", "_leaf"))
        old = self._saved_records(at, saved, open_leaves, n)
        same = self.key if self.by_key else [*self.key, "_hash"]
        fresh = null_safe_join(now, old.hint("merge"), same, "left_anti")
        if self.by_key:
            rest = [c for c in rows.columns if c not in self.key]
            out = fresh.groupBy(*self.key).agg(*[F.max(c).alias(c) for c in rest]).select(*rows.columns).withColumn("_change", F.lit("upsert"))
        else:
            gone = null_safe_join(old, now.select(*self.key).distinct().hint("merge"), self.key, "left_anti").select(*self.key).distinct()
            out = fresh.select(*rows.columns).distinct().withColumn("_change", F.lit("upsert")).unionByName(gone.withColumn("_change", F.lit("delete")), allowMissingColumns=True)
        if not publish:
            return durable(out)
        folder = f"{self.root}/versions/{at + 1}"
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/output")
        self._publish(at + 1, now, tree, saved, open_leaves)
        return self.spark.read.schema(out.schema).parquet(f"{folder}/output")
