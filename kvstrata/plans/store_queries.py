"""Queries of the key-value operators over whole tables, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvstrata.functions import bloom, keys
from kvstrata.operators import blocks, manifest, picker, read, write
from kvstrata.operators import compact as compaction
from kvstrata.operators.changes import live_files
from kvstrata.operators.ordering import key_ranks
from kvstrata.sources.kv import BATCH, LEVEL1_BASE, USERS_PER_FILE, events_with_files, kv_events, kv_from_events, kv_orders, log_keys
from kvstrata.sources.scratch import durable
from kvstrata.sources.tables import file_number, table
from kvstrata.streaming.ingest import read_table_stream, stream_apply as apply_stream

CF, KEY, SNAPSHOT, SNAPSHOTS = 1, "0000000007", 700, [300, 700]
START, END, TARGET, PREFIX, PAGE = "0000000003", "0000000010", "0000000005x", "00000000", 5
KEYS_PER_FILE, FILE_BYTES = 256, 4096
#: A key and a range of keys for which recorded files are pruned.
FILE_KEY, FILE_START, FILE_END = "cfg/route-map/primary", "acct/0", "cfg"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KV = """kv AS (SELECT CAST(user_id % 3 AS INTEGER) AS cf, lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, user_id FROM events)"""
ORD = """ord AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS cf, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS key, o_orderkey AS seq,
  CASE WHEN o_orderstatus = 'F' THEN 'DEL' ELSE 'PUT' END AS op, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"""


def live_sql(where: str = "true", source: str = "kv") -> str:
    """Newest visible version per key of the rows that meet a condition."""
    return f"""live AS (SELECT cf, key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC, op DESC) AS rn FROM {source} WHERE {where}) x WHERE rn = 1 AND op = 'PUT')"""


def _scan_sql(where: str = "true", tail: str = "") -> str:
    return f"WITH {KV}, {live_sql(where)} SELECT cf, key, seq, value FROM live {tail}"


# Reads


@query(_scan_sql(f"cf = {CF} AND key = '{KEY}'"))
def point_get(spark, d):
    return read.point_get(kv_events(spark, d), CF, KEY)


def _sources(spark, d):
    kv = kv_events(spark, d)
    return [kv.where(F.col("seq") % 4 == i) for i in range(4)]


@query(_scan_sql(f"cf = {CF} AND key = '{KEY}' AND seq <= {SNAPSHOT}"))
def merged_get(spark, d):
    return read.point_get(read.union_sources(_sources(spark, d)), CF, KEY, SNAPSHOT)


@query(_scan_sql(f"cf = {CF} AND key = '{KEY}' AND seq <= {SNAPSHOT}"))
def pruned_get(spark, d):
    kv = events_with_files(spark, d, 1)
    return read.pruned_get(kv, compaction.file_stats(kv, ["file_id"]), CF, KEY, SNAPSHOT)


@query(f"""WITH {KV}, {live_sql()}, asked AS (SELECT DISTINCT CAST(c_custkey % 3 AS INTEGER) AS cf, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer)
SELECT a.cf, a.key, l.seq, l.value, l.seq IS NOT NULL AS found FROM asked a LEFT JOIN live l ON l.cf = a.cf AND l.key = a.key""")
def multi_get(spark, d):
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 3).cast("int").alias("cf"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("key"))
    return read.multi_get(kv_events(spark, d), asked)


@query(_scan_sql())
def forward_scan(spark, d):
    return read.scan(kv_events(spark, d))


@query(_scan_sql(f"seq <= {SNAPSHOT}"))
def snapshot_scan(spark, d):
    return read.scan(kv_events(spark, d), SNAPSHOT)


@query(_scan_sql(f"cf = {CF} AND key >= '{TARGET}'", "ORDER BY key LIMIT 1"))
def seek_ge(spark, d):
    return read.seek(kv_events(spark, d), CF, TARGET)


@query(_scan_sql(f"cf = {CF} AND key <= '{TARGET}'", "ORDER BY key DESC LIMIT 1"))
def seek_le(spark, d):
    return read.seek(kv_events(spark, d), CF, TARGET, reverse=True)


@query(_scan_sql(f"cf = {CF}", "ORDER BY key LIMIT 1"))
def seek_first(spark, d):
    return read.page(kv_events(spark, d), CF, 1)


@query(_scan_sql(f"cf = {CF}", "ORDER BY key DESC LIMIT 1"))
def seek_last(spark, d):
    return read.page(kv_events(spark, d), CF, 1, reverse=True)


@query(_scan_sql(f"cf = {CF} AND key > '{KEY}'", f"ORDER BY key LIMIT {PAGE}"))
def page_next(spark, d):
    return read.page(kv_events(spark, d), CF, PAGE, F.col("key") > KEY)


@query(_scan_sql(f"cf = {CF} AND key < '{KEY}'", f"ORDER BY key DESC LIMIT {PAGE}"))
def page_prev(spark, d):
    return read.page(kv_events(spark, d), CF, PAGE, F.col("key") < KEY, reverse=True)


@query(_scan_sql())
def reverse_scan(spark, d):
    return read.scan(kv_events(spark, d), reverse=True)


@query(_scan_sql(f"key >= '{START}' AND key < '{END}'"))
def range_scan(spark, d):
    return read.scan(kv_events(spark, d), bounds=read.key_range(START, END))


@query(f"WITH {KV} SELECT cf, key, seq, op, value FROM kv WHERE key >= '{START}' AND key < '{END}'")
def range_scan_versions(spark, d):
    return read.versions(kv_events(spark, d), read.key_range(START, END))


@query(_scan_sql("cf = 2"))
def cf_scan(spark, d):
    return read.scan(kv_events(spark, d), bounds=F.col("cf") == 2)


@query(_scan_sql(f"key LIKE '{PREFIX}%'"))
def prefix_scan(spark, d):
    return read.scan(kv_events(spark, d), bounds=F.col("key").startswith(PREFIX))


@query(f"WITH {KV}, {ORD} SELECT 'events' AS source, cf, key, seq, op FROM kv UNION ALL SELECT 'orders', cf, key, seq, op FROM ord")
def merge_versions(spark, d):
    named = [kv.select(F.lit(n).alias("source"), "cf", "key", "seq", "op") for n, kv in (("events", kv_events(spark, d)), ("orders", kv_orders(spark, d)))]
    return read.union_sources(named).orderBy("cf", "key", F.desc("seq"), "source")


@query(_scan_sql())
def merged_scan(spark, d):
    return read.scan(read.union_sources(_sources(spark, d)))


@query(f"""WITH {KV}, probes AS (SELECT DISTINCT cf, key, s AS snapshot FROM kv, (VALUES (300), (700), (1000000)) v(s)),
hit AS (SELECT p.cf, p.key, p.snapshot, k.seq, k.op, k.value, row_number() OVER (PARTITION BY p.cf, p.key, p.snapshot ORDER BY k.seq DESC) AS rn FROM probes p JOIN kv k ON k.cf = p.cf AND k.key = p.key AND k.seq <= p.snapshot)
SELECT cf, key, CAST(snapshot AS BIGINT) AS snapshot, seq, value FROM hit WHERE rn = 1 AND op = 'PUT'""")
def asof_get(spark, d):
    kv = kv_events(spark, d)
    probes = kv.select("cf", "key").distinct().withColumn("snapshot", F.explode(F.array(*[F.lit(x).cast("long") for x in (300, 700, 1_000_000)])))
    return read.as_of(kv, probes)


@query(f"WITH {KV}, {live_sql()} SELECT cf, CAST(count(*) AS BIGINT) AS n_live FROM live GROUP BY cf")
def live_count(spark, d):
    return read.visible(kv_events(spark, d)).groupBy("cf").agg(F.count("*").alias("n_live"))


@query("""WITH n AS (SELECT db_id, cf, user_key, count(DISTINCT seqno) AS n_versions FROM kv_log WHERE user_key IS NOT NULL GROUP BY 1, 2, 3)
SELECT CAST(n_versions AS BIGINT) AS n_versions, CAST(count(*) AS BIGINT) AS n_keys FROM n GROUP BY 1""")
def version_histogram(spark, d):
    ops = table(spark, d, "kv_log").where("user_key IS NOT NULL").select("db_id", "cf", "user_key", "seqno").distinct()
    return ops.groupBy("db_id", "cf", "user_key").agg(F.count("*").alias("n_versions")).groupBy("n_versions").agg(F.count("*").alias("n_keys"))


@query(f"""WITH {KV}, {live_sql()} SELECT substr(key, 1, 8) AS prefix, CAST(count(*) AS BIGINT) AS n_keys, CAST(max(seq) AS BIGINT) AS newest FROM live GROUP BY 1""")
def prefix_group(spark, d):
    return read.visible(kv_events(spark, d)).groupBy(F.substring("key", 1, 8).alias("prefix")).agg(F.count("*").alias("n_keys"), F.max("seq").alias("newest"))


# Writes


def _batches(spark, d):
    b = F.floor(F.col("event_id") / BATCH).cast("long")
    return kv_events(spark, d, b.alias("batch_id"), (F.col("event_id") % BATCH).alias("ordinal"))


_SEQ = f"""{KV.replace('user_id FROM', f'event_id // {BATCH} AS batch_id, event_id % {BATCH} AS ordinal FROM')},
sizes AS (SELECT batch_id, count(*) AS n_ops FROM kv GROUP BY 1),
seqs AS (SELECT batch_id, CAST(sum(n_ops) OVER (ORDER BY batch_id) - n_ops + 1 AS BIGINT) AS first_seq, CAST(sum(n_ops) OVER (ORDER BY batch_id) AS BIGINT) AS last_seq, CAST(n_ops AS BIGINT) AS n_ops FROM sizes)"""


@query(f"WITH {KV} SELECT cf, key, seq, op, CAST(NULL AS VARCHAR) AS value FROM kv WHERE op = 'DEL'")
def tombstone_rows(spark, d):
    return write.tombstones(kv_events(spark, d))


@query(f"WITH {_SEQ} SELECT batch_id, cf, op, CAST(count(*) AS BIGINT) AS n_ops, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS n_bytes FROM kv GROUP BY 1, 2, 3")
def batch_ops(spark, d):
    return write.batch_operations(_batches(spark, d))


@query(f"WITH {_SEQ} SELECT batch_id, first_seq, last_seq, n_ops FROM seqs")
def assign_sequence(spark, d):
    return write.assign_sequence(_batches(spark, d))


@query(f"WITH {_SEQ}, numbered AS (SELECT k.cf, k.key, s.first_seq + k.ordinal AS seq, k.op, k.value FROM kv k JOIN seqs s USING (batch_id)), {live_sql(source='numbered')} SELECT cf, key, seq, value FROM live")
def apply_batches(spark, d):
    return read.scan(write.number_operations(_batches(spark, d).drop("seq")))


@query(f"""WITH {_SEQ}, gap AS (SELECT min(batch_id) AS g FROM seqs WHERE batch_id % 7 = 3)
SELECT CAST(max(batch_id) AS BIGINT) AS last_batch, CAST(max(last_seq) AS BIGINT) AS last_seq FROM seqs, gap WHERE batch_id < g OR g IS NULL""")
def commit_watermark(spark, d):
    ops = _batches(spark, d)
    return write.commit_watermark(ops.where("batch_id % 7 <> 3"), write.assign_sequence(ops))


_CATALOG = """cfe AS (SELECT DISTINCT db_id, cf, edit_no, kind, cf_name FROM edits WHERE kind IN ('ADD_CF', 'DROP_CF') AND cf IS NOT NULL),
cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, cf ORDER BY edit_no DESC) AS rn FROM cfe) x WHERE rn = 1)"""


@query(f"WITH {_CATALOG} SELECT db_id, cf, cf_name, edit_no FROM cat WHERE kind = 'ADD_CF'")
def cf_catalog(spark, d):
    return write.family_catalog(table(spark, d, "edits"))


@query(f"""WITH {KV}, {ORD}, one AS (SELECT cf, key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM ord) x WHERE rn = 1),
alls AS (SELECT cf, key, seq, op, value FROM kv UNION ALL SELECT cf, key, (SELECT max(seq) + 1 FROM kv), op, value FROM one), {live_sql(source='alls')} SELECT cf, key, seq, value FROM live""")
def ingest_global_seq(spark, d):
    return read.visible(write.ingest_global_sequence(kv_events(spark, d), write.one_per_key(kv_orders(spark, d))))


# Compaction

_STRIPE = f"CASE WHEN seq <= 300 THEN 300 WHEN seq <= 700 THEN 700 ELSE {keys.MAX_SEQUENCE} END"
_KEPT = f"""{KV}, st AS (SELECT *, {_STRIPE} AS stripe FROM kv),
nw AS (SELECT *, row_number() OVER (PARTITION BY cf, key, stripe ORDER BY seq DESC) AS rn FROM st),
kept AS (SELECT *, lead(seq) OVER (PARTITION BY cf, key ORDER BY seq DESC) AS older FROM nw WHERE rn = 1)"""
_NEWEST = f"{KV}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM kv) x WHERE rn = 1)"


@query(f"WITH {KV} SELECT cf, key, seq, CAST(CASE WHEN seq > 700 THEN 700 WHEN seq > 300 THEN 300 ELSE 0 END AS BIGINT) AS prev_snapshot, CAST({_STRIPE} AS BIGINT) AS stripe FROM kv")
def snapshot_stripe(spark, d):
    return kv_events(spark, d).select("cf", "key", "seq", compaction.previous_snapshot(SNAPSHOTS).alias("prev_snapshot"), compaction.stripe(SNAPSHOTS).alias("stripe"))


@query(f"WITH {_NEWEST} SELECT cf, key, seq, op, value FROM kept")
def compact(spark, d):
    return compaction.compact(kv_events(spark, d))


@query(f"WITH {_KEPT} SELECT cf, key, seq, op, value FROM kept")
def compact_snapshots(spark, d):
    return compaction.compact(kv_events(spark, d), SNAPSHOTS)


@query(f"WITH {_KEPT} SELECT cf, key, seq, op, value FROM kept WHERE NOT (op = 'DEL' AND older IS NULL)")
def compact_bottommost(spark, d):
    return compaction.compact(kv_events(spark, d), SNAPSHOTS, bottommost=True)


_STATS = """min(key) AS smallest, max(key) AS largest, CAST(min(seq) AS BIGINT) AS smallest_seq, CAST(max(seq) AS BIGINT) AS largest_seq, CAST(count(*) AS BIGINT) AS num_entries,
CAST(count(*) FILTER (WHERE op = 'DEL') AS BIGINT) AS num_deletions, CAST(sum(strlen(key)) AS BIGINT) AS raw_key_bytes, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS raw_value_bytes"""


@query(f"WITH {_NEWEST} SELECT cf, {_STATS} FROM kept GROUP BY cf")
def flush(spark, d):
    return compaction.flush(kv_events(spark, d))


@query(f"""WITH {_NEWEST}, z AS (SELECT *, strlen(key) + coalesce(strlen(value), 0) AS size FROM kept), r AS (SELECT *, (sum(size) OVER (PARTITION BY cf ORDER BY key) - size) // {FILE_BYTES} AS file_no FROM z)
SELECT cf, CAST(file_no AS BIGINT) AS file_no, min(key) AS smallest, max(key) AS largest, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def compact_files(spark, d):
    out = compaction.split_files(kv_events(spark, d), FILE_BYTES)
    return out.groupBy("cf", "file_no").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("n"))


# Metadata

_FN = "(packed_number_and_path_id & 4611686018427387903)"
_LIVE = f"""ev AS (SELECT DISTINCT db_id, {_FN} AS file_number, edit_no, kind, cf, file_level FROM edits WHERE kind IN ('ADD_FILE', 'DEL_FILE')),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, file_number ORDER BY edit_no DESC) AS rn FROM ev) x WHERE rn = 1 AND kind = 'ADD_FILE')"""
_LATEST = f"latest AS (SELECT * FROM (SELECT *, {_FN} AS file_number, row_number() OVER (PARTITION BY db_id, {_FN} ORDER BY meta_rev DESC, file_size DESC NULLS LAST) AS rn FROM files) x WHERE rn = 1)"


@query(f"WITH {_LIVE}, {_CATALOG} SELECT l.db_id, l.cf, l.file_level, l.file_number, l.edit_no FROM live l LEFT JOIN cat c ON c.db_id = l.db_id AND c.cf = l.cf WHERE coalesce(c.kind, 'ADD_CF') = 'ADD_CF'")
def manifest_replay(spark, d):
    return manifest.replay(table(spark, d, "edits"))


_ALL_LIVE = f"WITH {_LIVE} SELECT db_id, cf, file_level, file_number, edit_no FROM live"
#: Edits up to this number make the old version or checkpoint; each scale has databases below and above.
HALF = 150


@query(_ALL_LIVE)
def manifest_checkpoint(spark, d):
    edits = table(spark, d, "edits")
    return manifest.replay_from(durable(manifest.checkpoint(edits, HALF)), edits.where(F.col("edit_no") > HALF))


@query(_ALL_LIVE)
def version_apply(spark, d):
    edits = table(spark, d, "edits")
    later = edits.where((F.col("edit_no") > HALF) & F.col("kind").isin("ADD_FILE", "DEL_FILE"))
    touched = later.select("db_id", file_number("packed_number_and_path_id").alias("file_number"))
    added = live_files(later).select(*manifest.FILE_STATE)
    return manifest.apply_version(durable(manifest.checkpoint(edits, HALF)), touched, added)


def _files_sql(level: int) -> str:
    file_id = f"seq // {BATCH}" if level == 0 else f"user_id // {USERS_PER_FILE} + {LEVEL1_BASE}"
    return f"fs AS (SELECT CAST({file_id} AS BIGINT) AS file_id, {_STATS} FROM kv GROUP BY 1)"


@query(f"WITH {KV}, {_files_sql(0)} SELECT * FROM fs")
def file_stats(spark, d):
    return compaction.file_stats(events_with_files(spark, d, 0), ["file_id"])


@query(f"WITH {_LATEST} SELECT db_id, cf, file_number, smallest, largest FROM latest WHERE smallest <= '{FILE_KEY}' AND largest >= '{FILE_KEY}'")
def file_prune_point(spark, d):
    """The recorded files that can hold a key, from their stored ranges."""
    return manifest.latest_files(table(spark, d, "files")).where((F.col("smallest") <= FILE_KEY) & (F.col("largest") >= FILE_KEY)).select("db_id", "cf", "file_number", "smallest", "largest")


@query(f"WITH {_LATEST} SELECT db_id, cf, file_number, smallest, largest FROM latest WHERE smallest < '{FILE_END}' AND largest >= '{FILE_START}'")
def file_prune_range(spark, d):
    """The recorded files that can hold keys of a range, from their stored ranges."""
    return manifest.latest_files(table(spark, d, "files")).where((F.col("smallest") < FILE_END) & (F.col("largest") >= FILE_START)).select("db_id", "cf", "file_number", "smallest", "largest")


@query(f"""WITH {_LATEST}, f AS (SELECT db_id, cf, file_number AS file_id, file_level AS level, smallest, largest, CASE WHEN file_size > 0 THEN file_size ELSE 0 END AS file_size FROM latest)
SELECT a.db_id, a.cf, a.level, a.file_id, CAST(count(b.file_id) AS BIGINT) AS n_overlap, CAST(coalesce(sum(b.file_size), 0) AS BIGINT) AS overlap_bytes
FROM f a LEFT JOIN f b ON b.db_id = a.db_id AND b.cf = a.cf AND b.level = a.level + 1 AND b.smallest <= a.largest AND b.largest >= a.smallest GROUP BY 1, 2, 3, 4""")
def file_overlap(spark, d):
    known = F.when(F.col("file_size") > 0, F.col("file_size")).otherwise(0)
    files = durable(manifest.latest_files(table(spark, d, "files")).select("db_id", "cf", F.col("file_level").alias("level"), F.col("file_number").alias("file_id"), "smallest", "largest", known.cast("long").alias("file_size"), "being_compacted"))
    below = files.withColumn("level", F.col("level") - 1)
    return picker.overlap_totals(files, below, ["db_id", "cf", "level"]).select("db_id", "cf", "level", "file_id", "n_overlap", "overlap_bytes")


# The picker over every recorded file, by database and family


def _recorded(spark, d):
    """(sizing options of the ``level_targets`` table, recorded files with their database and family as ``grp``); unknown sizes count as 0."""
    rows = table(spark, d, "level_targets").where("file_level IS NOT NULL").orderBy("file_level").limit(100).collect()  # one row per level
    limits = [r.max_level_bytes for r in rows if r.max_level_bytes and r.max_level_bytes > 0]
    plain = picker.LevelOptions()
    options = picker.LevelOptions(
        max_level=rows[-1].file_level + 1 if rows else plain.max_level, base_bytes=limits[0] if limits else plain.base_bytes, multiplier=limits[1] / limits[0] if len(limits) > 1 else plain.multiplier
    )
    known = F.when(F.col("file_size") > 0, F.col("file_size")).otherwise(0).cast("long")
    files = manifest.latest_files(table(spark, d, "files"))
    return options, durable(files.select(F.struct("db_id", "cf").alias("grp"), F.col("file_level").alias("level"), F.col("file_number").alias("file_id"), "smallest", "largest", known.alias("file_size"), "being_compacted"))


def _recorded_choice(spark, d):
    """(files, the files that the compactions of all groups start from)."""
    options, files = _recorded(spark, d)
    picked = durable(picker.pick_level(picker.level_scores(files, "grp", options), "grp"))
    return files, picker.pick_files(files, picked, "grp")


#: The sizing rule in SQL: level sums, the largest level divided down to the base level, and the targets from there.
_RECORDED = f"""{_LATEST}, lim AS (SELECT max_level_bytes AS b, row_number() OVER (ORDER BY file_level) AS rn FROM level_targets WHERE max_level_bytes > 0),
opt AS (SELECT coalesce((SELECT b FROM lim WHERE rn = 1), 268435456) AS base, coalesce((SELECT CAST(b AS DOUBLE) FROM lim WHERE rn = 2) / (SELECT b FROM lim WHERE rn = 1), 10.0) AS mult, (SELECT max(file_level) FROM level_targets) AS deep),
f AS (SELECT db_id, cf, file_number AS file_id, file_level AS level, smallest, largest, CAST(CASE WHEN file_size > 0 THEN file_size ELSE 0 END AS BIGINT) AS size, coalesce(being_compacted, false) AS busy FROM latest),
lv AS (SELECT db_id, cf, level, count(*) AS n, CAST(sum(size) AS BIGINT) AS b, CAST(sum(CASE WHEN busy THEN 0 ELSE size END) AS BIGINT) AS idle, bool_or(busy) AS busy FROM f WHERE level IS NOT NULL GROUP BY 1, 2, 3),
g0 AS (SELECT db_id, cf, CAST(coalesce(sum(n) FILTER (WHERE level = 0), 0) AS BIGINT) AS n0, CAST(coalesce(sum(b) FILTER (WHERE level = 0), 0) AS BIGINT) AS b0, coalesce(bool_or(busy) FILTER (WHERE level = 0), false) AS busy0,
  coalesce(max(b) FILTER (WHERE level > 0), 0) AS biggest, min(level) FILTER (WHERE level > 0 AND b > 0) AS top FROM lv GROUP BY 1, 2),
g AS (SELECT *, greatest(b0, base) AS ceiling, floor(greatest(b0, base) / mult + 0.5) AS lowest FROM g0, opt),
st AS (SELECT db_id, cf, top, deep, mult, ceiling, 0 AS j, CAST(biggest AS DOUBLE) AS size FROM g WHERE biggest > 0
  UNION ALL SELECT db_id, cf, top, deep, mult, ceiling, j + 1, floor(size / mult + 0.5) FROM st WHERE j < deep - 1),
stop AS (SELECT db_id, cf, min(j) AS j FROM st WHERE j >= deep - top AND (size <= ceiling OR j = deep - 1) GROUP BY 1, 2),
based AS (SELECT g.*, CASE WHEN a.size <= lowest THEN g.top ELSE g.deep - e.j END AS bl, CASE WHEN a.size <= lowest THEN lowest + 1 ELSE least(z.size, g.ceiling) END AS s0
  FROM g JOIN stop e ON e.db_id = g.db_id AND e.cf IS NOT DISTINCT FROM g.cf JOIN st a ON a.db_id = g.db_id AND a.cf IS NOT DISTINCT FROM g.cf AND a.j = g.deep - g.top JOIN st z ON z.db_id = g.db_id AND z.cf IS NOT DISTINCT FROM g.cf AND z.j = e.j),
grown AS (SELECT *, CASE WHEN b0 > s0 AND (b0 > base OR n0 // 2 > 4) THEN CAST(b0 AS DOUBLE) ELSE s0 END AS s1 FROM based),
fac AS (SELECT *, CASE WHEN bl = deep THEN 1.0 ELSE pow(biggest / s1, 1.0 / (deep - bl)) END AS factor FROM grown),
tg AS (SELECT db_id, cf, bl AS level, s1 AS size, factor, ceiling, deep FROM fac UNION ALL SELECT db_id, cf, level + 1, floor(size * factor + 0.5), factor, ceiling, deep FROM tg WHERE level < deep),
sized AS (SELECT g.db_id, g.cf, g.n0, g.b0, g.busy0, g.base, g.deep, coalesce(x.bl, g.deep) AS bl, CAST(coalesce(x.factor, 1.0) AS DOUBLE) AS factor, greatest(x.s1, x.ceiling) AS low FROM g LEFT JOIN fac x ON x.db_id = g.db_id AND x.cf IS NOT DISTINCT FROM g.cf),
levels AS (SELECT s.*, CAST(r.l AS INTEGER) AS level, CAST(greatest(t.size, t.ceiling) AS BIGINT) AS target, coalesce(lv.idle, 0) AS idle
  FROM sized s CROSS JOIN range(0, 100) r(l) LEFT JOIN tg t ON t.db_id = s.db_id AND t.cf IS NOT DISTINCT FROM s.cf AND t.level = r.l LEFT JOIN lv ON lv.db_id = s.db_id AND lv.cf IS NOT DISTINCT FROM s.cf AND lv.level = r.l WHERE r.l <= s.deep),
scores AS (SELECT db_id, cf, level, bl, CASE WHEN level > 0 THEN coalesce(idle / target, 0.0) ELSE greatest(n0 / 4, coalesce(b0 / greatest(base, floor(low / factor + 0.5)), 0.0)) END AS score FROM levels WHERE level < deep AND NOT (level = 0 AND busy0)),
picked AS (SELECT db_id, cf, level, CASE WHEN level = 0 THEN bl ELSE level + 1 END AS output_level FROM (SELECT *, row_number() OVER (PARTITION BY db_id, cf ORDER BY score DESC, level) AS rn FROM scores) x WHERE rn = 1 AND score >= 1),
own AS (SELECT f.*, p.output_level FROM f JOIN picked p ON p.db_id = f.db_id AND p.cf IS NOT DISTINCT FROM f.cf AND p.level = f.level),
met AS (SELECT a.db_id, a.cf, a.file_id, coalesce(sum(b.size), 0) // a.size AS ratio FROM own a LEFT JOIN f b ON b.db_id = a.db_id AND b.cf IS NOT DISTINCT FROM a.cf AND b.level = a.level + 1 AND b.smallest <= a.largest AND b.largest >= a.smallest
  WHERE a.level > 0 AND NOT a.busy AND a.size > 0 GROUP BY a.db_id, a.cf, a.file_id, a.size HAVING NOT coalesce(bool_or(b.busy), false)),
chosen AS (SELECT * FROM own WHERE level = 0 UNION ALL SELECT o.* FROM own o JOIN (SELECT *, row_number() OVER (PARTITION BY db_id, cf ORDER BY ratio, file_id) AS rn FROM met) m ON m.rn = 1 AND m.db_id = o.db_id AND m.file_id = o.file_id),
hull AS (SELECT db_id, cf, output_level, min(smallest) AS lo, max(largest) AS hi FROM chosen GROUP BY 1, 2, 3),
more AS (SELECT f.*, h.output_level FROM f JOIN hull h ON h.db_id = f.db_id AND h.cf IS NOT DISTINCT FROM f.cf AND f.level = h.output_level AND f.smallest <= h.hi AND f.largest >= h.lo)"""


@query(f"WITH RECURSIVE {_RECORDED} SELECT db_id, cf, level, CAST(bl AS INTEGER) AS base_level, target, round(factor, 6) AS factor FROM levels")
def level_targets(spark, d):
    options, files = _recorded(spark, d)
    return picker.level_scores(files, "grp", options).select("grp.*", "level", "base_level", "target", F.round("factor", 6).alias("factor"))


@query(f"WITH RECURSIVE {_RECORDED} SELECT db_id, cf, level, CAST(round(score, 6) AS DOUBLE) AS score FROM scores")
def compaction_score(spark, d):
    options, files = _recorded(spark, d)
    return picker.level_scores(files, "grp", options).where("score IS NOT NULL").select("grp.*", "level", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_RECORDED} SELECT db_id, cf, level, CAST(output_level AS INTEGER) AS output_level FROM picked")
def pick_level(spark, d):
    options, files = _recorded(spark, d)
    return picker.pick_level(picker.level_scores(files, "grp", options), "grp").select("grp.*", "level", "output_level")


@query(f"WITH RECURSIVE {_RECORDED} SELECT db_id, cf, file_id FROM chosen")
def pick_files(spark, d):
    return _recorded_choice(spark, d)[1].select("grp.*", "file_id")


@query(f"""WITH RECURSIVE {_RECORDED} SELECT DISTINCT x.db_id, x.cf, x.file_id, CAST(x.output_level AS INTEGER) AS output_level
FROM (SELECT db_id, cf, file_id, output_level FROM chosen UNION ALL SELECT db_id, cf, file_id, output_level FROM more) x
WHERE NOT EXISTS (SELECT 1 FROM more m WHERE m.busy AND m.db_id = x.db_id AND m.cf IS NOT DISTINCT FROM x.cf)""")
def expand_inputs(spark, d):
    files, chosen = _recorded_choice(spark, d)
    return picker.expand_inputs(files, durable(chosen), "grp").select("grp.*", "file_id", "output_level")


@query(f"WITH {_LATEST} SELECT cf, file_level, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(CASE WHEN file_size > 0 THEN file_size ELSE 0 END) AS BIGINT) AS n_bytes FROM latest GROUP BY 1, 2")
def level_stats(spark, d):
    return manifest.level_stats(manifest.latest_files(table(spark, d, "files")), ["cf"])


_LOGS = "need AS (SELECT db_id, cf, max(log_number) AS lg FROM edits WHERE log_number > 0 AND cf IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {_LOGS}, least AS (SELECT db_id, min(lg) AS m FROM need GROUP BY 1)
SELECT DISTINCT k.db_id, k.log_number FROM kv_log k JOIN least l ON l.db_id = k.db_id AND k.log_number < l.m""")
def wal_gc(spark, d):
    return manifest.removable_logs(table(spark, d, "edits"), table(spark, d, "kv_log"))


@query(f"""WITH {_LOGS}, ops AS (SELECT db_id, cf, seqno, max(log_number) AS ol FROM kv_log WHERE tp <> 3 GROUP BY 1, 2, 3)
SELECT o.db_id, o.cf, CAST(count(*) AS BIGINT) AS n_ops FROM ops o JOIN need n ON n.db_id = o.db_id AND n.cf = o.cf WHERE o.ol >= n.lg GROUP BY 1, 2""")
def wal_replay(spark, d):
    return manifest.replayed_operations(table(spark, d, "edits"), table(spark, d, "kv_log"))


@query(f"SELECT db_id, CAST(coalesce(max({_FN}), 0) + 1 AS BIGINT) AS next_file, max(last_sequence) AS last_sequence, coalesce(max(cf), 0) AS max_cf, max(log_number) AS max_log FROM edits GROUP BY 1")
def counters(spark, d):
    return manifest.counters(table(spark, d, "edits"))


@query(f"WITH {_LIVE} SELECT DISTINCT f.db_id, f.packed_number_and_path_id & 4611686018427387903 AS file_number FROM files f LEFT JOIN live l ON l.db_id = f.db_id AND l.file_number = (f.packed_number_and_path_id & 4611686018427387903) WHERE l.file_number IS NULL")
def obsolete_files(spark, d):
    return manifest.obsolete_files(table(spark, d, "edits"), table(spark, d, "files"))


# Scalars and encodings

_TAG = "(seqno << 8) | tp"
_INTERNAL = f"hex(encode(user_key)) || array_to_string(list_reverse(regexp_extract_all(lpad(to_hex({_TAG}), 16, '0'), '..')), '')"
_OPS = "o AS (SELECT DISTINCT db_id, seqno, tp, user_key FROM kv_log WHERE user_key IS NOT NULL)"


def _keyed_ops(spark, d):
    return table(spark, d, "kv_log").where("user_key IS NOT NULL").select("db_id", "seqno", "tp", "user_key").distinct()


@query(f"WITH {_OPS} SELECT db_id, seqno, {_INTERNAL} AS internal_key FROM o")
def internal_key_encode(spark, d):
    return _keyed_ops(spark, d).select("db_id", "seqno", keys.internal_key_hex("user_key", "seqno", "tp").alias("internal_key"))


@query(f"WITH {_OPS} SELECT db_id, user_key, seqno, tp FROM o")
def internal_key_decode(spark, d):
    packed = _keyed_ops(spark, d).select("db_id", keys.internal_key_hex("user_key", "seqno", "tp").alias("x"))
    return packed.select("db_id", keys.user_key_of("x").alias("user_key"), keys.sequence_of("x").alias("seqno"), keys.value_type_of("x").alias("tp"))


@query("SELECT tp, tp <= 2 OR tp = 17 AS is_value, tp <= 2 OR tp IN (15, 17) AS is_extended, CAST(count(*) AS BIGINT) AS n FROM kv_log GROUP BY 1")
def value_type_class(spark, d):
    rows = table(spark, d, "kv_log").groupBy("tp").agg(F.count("*").alias("n"))
    return rows.select("tp", keys.is_value_type("tp").alias("is_value"), keys.is_extended_value_type("tp").alias("is_extended"), "n")


def _byte(h: str, at: str) -> str:
    """Value of one byte (from 0) of a hexadecimal string, in SQL."""
    digit = "(strpos('0123456789ABCDEF', substr({h}, {p}, 1)) - 1)"
    return f"({digit.format(h=h, p=f'2 * ({at}) + 1')} * 16 + {digit.format(h=h, p=f'2 * ({at}) + 2')})"


def _grown(h: str, at: str) -> str:
    """The first bytes of a hexadecimal string up to one that is grown by one, in SQL; text in UTF-8 has no byte 255."""
    return f"substr({h}, 1, 2 * ({at})) || lpad(upper(to_hex({_byte(h, at)} + 1)), 2, '0')"


_K = f"""k AS (SELECT *, hex(encode(key)) AS h, CAST((row_number() OVER (PARTITION BY db_id, cf ORDER BY key) - 1) // {KEYS_PER_FILE} AS BIGINT) AS file_no
FROM (SELECT DISTINCT db_id, cf, user_key AS key FROM kv_log WHERE user_key IS NOT NULL) x)"""
_PAIRS = f"""{_K}, n AS (SELECT *, lead(key) OVER w AS following, lead(h) OVER w AS g FROM k WINDOW w AS (PARTITION BY db_id, cf, file_no ORDER BY key)),
c AS (SELECT *, length(h) // 2 AS a, length(g) // 2 AS b, len(list_filter(range(2, least(length(h), length(g)) + 1, 2), lambda i: substr(h, 1, i) = substr(g, 1, i))) AS same FROM n WHERE following IS NOT NULL)"""


def _key_files(spark, d):
    """The distinct keys of each family in sorted files of a bounded number of keys."""
    ranked = key_ranks(log_keys(spark, d), ["db_id", "cf"], "key")
    return ranked.withColumn("file_no", F.floor(F.col("key_rank") / KEYS_PER_FILE).cast("long")).drop("key_rank")


def _neighbours(spark, d):
    from pyspark.sql import Window

    return _key_files(spark, d).withColumn("following", F.lead("key").over(Window.partitionBy("db_id", "cf", "file_no").orderBy("key")))


@query(f"""WITH {_PAIRS} SELECT db_id, cf, key, following, CASE WHEN same = least(a, b) THEN h WHEN same + 1 < b OR {_byte('h', 'same')} + 1 < {_byte('g', 'same')} THEN {_grown('h', 'same')}
WHEN same + 1 < a THEN {_grown('h', 'same + 1')} ELSE h END AS separator_hex FROM c""")
def shortest_separator(spark, d):
    return _neighbours(spark, d).where("following IS NOT NULL").select("db_id", "cf", "key", "following", keys.shortest_separator_hex("key", "following").alias("separator_hex"))


@query(f"WITH {_K} SELECT db_id, cf, key, CASE WHEN h = '' THEN h ELSE {_grown('h', '0')} END AS successor_hex FROM k")
def short_successor(spark, d):
    return log_keys(spark, d).select("db_id", "cf", "key", keys.short_successor_hex("key").alias("successor_hex"))


@query(f"WITH {_K} SELECT db_id, cf, key, CASE WHEN h = '' THEN '00' ELSE {_grown('h', 'length(h) // 2 - 1')} END AS next_hex FROM k")
def next_key(spark, d):
    return log_keys(spark, d).select("db_id", "cf", "key", keys.next_key_hex("key").alias("next_hex"))


@query("""SELECT n_bytes, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5
WHEN v < 4398046511104 THEN 6 WHEN v < 562949953421312 THEN 7 WHEN v < 72057594037927936 THEN 8 ELSE 9 END AS n_bytes FROM (SELECT unnest([seqno, (seqno << 8) | tp, log_number]) AS v FROM kv_log) a WHERE v IS NOT NULL) b GROUP BY 1""")
def varint_length(spark, d):
    numbers = table(spark, d, "kv_log").select(F.explode(F.array("seqno", keys.pack_sequence_and_type("seqno", "tp"), "log_number")).alias("v")).where("v IS NOT NULL")
    return numbers.groupBy(keys.varint_length("v").alias("n_bytes")).agg(F.count("*").alias("n"))


@query(f"""WITH n AS (SELECT DISTINCT v FROM (SELECT unnest([seqno, (seqno << 8) | tp, log_number]) AS v FROM kv_log) a WHERE v IS NOT NULL),
d AS (SELECT v, unnest(range(0, 9)) AS i FROM n)
SELECT v AS number, string_agg(lpad(upper(to_hex(((v >> (7 * i)) & 127) + CASE WHEN (v >> (7 * i)) > 127 THEN 128 ELSE 0 END)), 2, '0'), '' ORDER BY i) AS encoded, v AS decoded FROM d WHERE i = 0 OR (v >> (7 * i)) > 0 GROUP BY v""")
def varint_code(spark, d):
    """Numbers in variable-length form, and back."""
    numbers = table(spark, d, "kv_log").select(F.explode(F.array("seqno", keys.pack_sequence_and_type("seqno", "tp"), "log_number")).alias("number")).where("number IS NOT NULL").distinct()
    return numbers.withColumn("encoded", keys.varint_hex("number")).withColumn("decoded", keys.varint_value("encoded"))


@query("""WITH h AS (SELECT DISTINCT hash_entry AS crc FROM probe_keys WHERE hash_entry IS NOT NULL)
SELECT crc, CAST((((crc >> 15) | ((crc << 17) & 4294967295)) + 2726488792) & 4294967295 AS BIGINT) AS masked, crc AS unmasked FROM h""")
def crc_mask(spark, d):
    crcs = table(spark, d, "probe_keys").where("hash_entry IS NOT NULL").select(F.col("hash_entry").alias("crc")).distinct().withColumn("masked", keys.crc_mask("crc"))
    return crcs.withColumn("unmasked", keys.crc_unmask("masked"))


@query(f"""WITH f AS (SELECT DISTINCT db_id, packed_number_and_path_id AS packed FROM files WHERE packed_number_and_path_id IS NOT NULL)
SELECT db_id, packed, packed & 4611686018427387903 AS number, CAST((packed >> 62) & 3 AS BIGINT) AS path_id, packed AS repacked FROM f""")
def file_number_pack(spark, d):
    f = table(spark, d, "files").where("packed_number_and_path_id IS NOT NULL").select("db_id", F.col("packed_number_and_path_id").alias("packed")).distinct()
    parts = f.withColumn("number", file_number("packed")).withColumn("path_id", keys.path_id("packed"))
    return parts.withColumn("repacked", keys.pack_file_number("number", "path_id"))


_NAMES = f"""f AS (SELECT DISTINCT {_FN} AS n FROM files WHERE packed_number_and_path_id IS NOT NULL),
p AS (SELECT n, CASE WHEN length(CAST(n AS VARCHAR)) < 6 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS s FROM f)"""


@query(f"WITH {_NAMES} SELECT n AS number, s || '.sst' AS table_name, s || '.log' AS log_name, 'MANIFEST-' || s AS manifest_name, 'log' AS log_type, n AS parsed FROM p")
def file_names(spark, d):
    f = table(spark, d, "files").where("packed_number_and_path_id IS NOT NULL").select(file_number("packed_number_and_path_id").alias("number")).distinct()
    named = f.select("number", keys.file_name("number", "sst").alias("table_name"), keys.file_name("number", "log").alias("log_name"), keys.manifest_name("number").alias("manifest_name"))
    return named.withColumn("log_type", keys.parse_file_type("log_name")).withColumn("parsed", keys.parse_file_number("manifest_name"))


@query("SELECT DISTINCT user_key, hash_entry FROM probe_keys WHERE user_key IS NOT NULL AND hash_entry IS NOT NULL")
def key_hash(spark, d):
    """The hash of each key beside which one is recorded; the recorded ones are what it must equal."""
    asked = table(spark, d, "probe_keys").where("user_key IS NOT NULL AND hash_entry IS NOT NULL").select("user_key").distinct()
    return asked.select("user_key", keys.key_hash_udf(keys.BLOOM_SEED)("user_key").alias("hash_entry"))


def _blocks(spark, d):
    return table(spark, d, "filter_blocks").groupBy("block_no").agg(F.max("hash_entries").alias("hash_entries"))


@query("""WITH b AS (SELECT block_no, max(hash_entries) AS h FROM filter_blocks GROUP BY 1),
n AS (SELECT block_no, coalesce(len(h), 0) AS n, CASE WHEN coalesce(len(h), 0) = 0 THEN 0 ELSE ((n * 10 + 511) // 512) // 2 * 2 + 1 END AS lines, h FROM b),
p AS (SELECT block_no, lines, x & 4294967295 AS x FROM (SELECT block_no, lines, unnest(h) AS x FROM n) u),
w AS (SELECT DISTINCT block_no, (x % lines) * 512 + ((x + ((x >> 17) | ((x << 15) & 4294967295)) * i) & 511) AS place FROM p, range(0, 7) r(i)),
y AS (SELECT block_no, place // 8 AS at, CAST(sum(1 << CAST(place % 8 AS INTEGER)) AS BIGINT) AS byte FROM w GROUP BY 1, 2),
f AS (SELECT z.block_no, string_agg(lpad(upper(to_hex(coalesce(y.byte, 0))), 2, '0'), '' ORDER BY z.at) AS bits FROM (SELECT block_no, unnest(range(lines * 64)) AS at FROM n) z LEFT JOIN y ON y.block_no = z.block_no AND y.at = z.at GROUP BY 1)
SELECT n.block_no, CAST(n.n AS BIGINT) AS n_hashes, CAST(n.lines AS BIGINT) AS lines, CAST(CASE WHEN n.n = 0 THEN 0 ELSE 7 END AS BIGINT) AS probes, coalesce(f.bits, '') AS bits_hex FROM n LEFT JOIN f ON f.block_no = n.block_no""")
def bloom_build(spark, d):
    built = bloom.build_filters(_blocks(spark, d), "block_no", "hash_entries")
    return built.select("block_no", "n_hashes", "lines", "probes", F.hex("bits").alias("bits_hex"))


@query("""WITH b AS (SELECT block_no, max(hash_entries) AS h FROM filter_blocks GROUP BY 1) SELECT block_no, CAST(coalesce(len(h), 0) AS BIGINT) AS n_probed, CAST(0 AS BIGINT) AS n_misses FROM b""")
def bloom_probe(spark, d):
    rows = durable(_blocks(spark, d))
    return bloom.probe_filters(rows.join(bloom.build_filters(rows, "block_no", "hash_entries"), "block_no"), "block_no", "hash_entries")


@query("""WITH k AS (SELECT DISTINCT db_id, cf, user_key FROM kv_log WHERE user_key IS NOT NULL)
SELECT db_id, cf, user_key AS filter_key, 'key' AS kind FROM k UNION SELECT db_id, cf, substr(user_key, 1, 4), 'prefix' FROM k WHERE length(user_key) >= 4""")
def filter_keys(spark, d):
    k = log_keys(spark, d)
    prefixes = k.where(F.char_length("key") >= 4).select("db_id", "cf", F.substring("key", 1, 4).alias("filter_key"), F.lit("prefix").alias("kind")).distinct()
    return k.select("db_id", "cf", F.col("key").alias("filter_key"), F.lit("key").alias("kind")).unionByName(prefixes)


_HEXKEYS = f"""{_K}, o AS (SELECT *, row_number() OVER w - 1 AS ordinal, lag(h) OVER w AS a, h AS b FROM k WINDOW w AS (PARTITION BY db_id, cf, file_no ORDER BY key)),
s AS (SELECT *, CASE WHEN ordinal % 16 = 0 THEN 0 ELSE len(list_filter(range(2, least(length(a), length(b)) + 1, 2), lambda i: substr(a, 1, i) = substr(b, 1, i))) END AS shared FROM o)"""
_FILE_KEY = ["db_id", "cf", "file_no"]


@query(f"WITH {_HEXKEYS} SELECT db_id, cf, file_no, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(shared) AS BIGINT) AS shared_bytes, CAST(sum(length(b) // 2 - shared) AS BIGINT) AS stored_bytes FROM s GROUP BY 1, 2, 3")
def delta_encoding_stats(spark, d):
    return blocks.delta_stats(_key_files(spark, d), _FILE_KEY)


@query(f"WITH {_HEXKEYS} SELECT db_id, cf, file_no, key, CAST(ordinal AS BIGINT) AS ordinal FROM s WHERE ordinal % 16 = 0")
def restart_points(spark, d):
    return blocks.restart_flags(_key_files(spark, d), _FILE_KEY).where("is_restart").select(*_FILE_KEY, "key", "ordinal")


def _varint_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 ELSE 4 END)"


#: Entries of each file in order, their sizes with and without a shared prefix, and the blocks they fall into one after the other.
_CUT = f"""{KV}, e AS (SELECT CAST(user_id // {USERS_PER_FILE} + {LEVEL1_BASE} AS BIGINT) AS file_id, key, hex(encode(key)) AS h, lag(hex(encode(key))) OVER w AS p, strlen(key) AS kl, coalesce(strlen(value), 0) AS vl, row_number() OVER w AS rn
  FROM kv WINDOW w AS (PARTITION BY user_id // {USERS_PER_FILE} ORDER BY key, seq DESC)),
s AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(2, least(length(h), length(p)) + 1, 2), lambda i: substr(h, 1, i) = substr(p, 1, i))) END AS shared FROM e),
z AS (SELECT *, 1 + {_varint_sql('(kl + 8)')} + {_varint_sql('vl')} + kl + 8 + vl AS whole, {_varint_sql('shared')} + {_varint_sql('(kl + 8 - shared)')} + {_varint_sql('vl')} + kl + 8 - shared + vl AS delta FROM s),
r AS (SELECT file_id, rn, key, key AS first_key, 0 AS block_no, 1 AS n, 8 + whole AS size FROM z WHERE rn = 1
  UNION ALL SELECT z.file_id, z.rn, z.key, CASE WHEN r.size >= {blocks.BLOCK_SIZE} THEN z.key ELSE r.first_key END, r.block_no + CASE WHEN r.size >= {blocks.BLOCK_SIZE} THEN 1 ELSE 0 END, CASE WHEN r.size >= {blocks.BLOCK_SIZE} THEN 1 ELSE r.n + 1 END,
    CASE WHEN r.size >= {blocks.BLOCK_SIZE} THEN 8 + z.whole WHEN r.n % {blocks.RESTART} = 0 THEN r.size + 4 + z.whole ELSE r.size + z.delta END FROM r JOIN z ON z.file_id = r.file_id AND z.rn = r.rn + 1),
cut AS (SELECT file_id, CAST(block_no AS BIGINT) AS block_no, min(first_key) AS first_key, max(key) AS last_key, CAST(max(n) AS BIGINT) AS n_entries, CAST(max(size) AS BIGINT) AS n_bytes FROM r GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_CUT} SELECT * FROM cut")
def block_cut(spark, d):
    return blocks.cut_blocks(events_with_files(spark, d, 1), "file_id")


@query(f"""WITH RECURSIVE {_CUT}, x AS (SELECT file_id, block_no, hex(encode(last_key)) AS h, lead(hex(encode(first_key))) OVER (PARTITION BY file_id ORDER BY block_no) AS g FROM cut),
c AS (SELECT *, length(h) // 2 AS a, length(g) // 2 AS b, len(list_filter(range(2, least(length(h), length(g)) + 1, 2), lambda i: substr(h, 1, i) = substr(g, 1, i))) AS same FROM x)
SELECT file_id, block_no, CASE WHEN g IS NULL THEN {_grown('h', '0')} WHEN same = least(a, b) THEN h WHEN same + 1 < b OR {_byte('h', 'same')} + 1 < {_byte('g', 'same')} THEN {_grown('h', 'same')}
  WHEN same + 1 < a THEN {_grown('h', 'same + 1')} ELSE h END AS separator_hex FROM c""")
def index_entries(spark, d):
    return blocks.index_entries(blocks.cut_blocks(events_with_files(spark, d, 1), "file_id"))


# Streaming


@query(_scan_sql())
def stream_apply(spark, d):
    return apply_stream(read_table_stream(spark, d, "events"), kv_from_events)
