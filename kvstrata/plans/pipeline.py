"""Queries p1 to p5 over whole tables, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvstrata.operators.changes import live_files, live_keys
from kvstrata.operators.incremental import IncrementalTable, covered_positions, covered_rows
from kvstrata.operators.orphans import life_spans, manifest_references, orphan_counts, orphans
from kvstrata.operators.seen import seen_before, wrong_answers
from kvstrata.operators.smallfiles import FileSet, described_files, flushed_entries, plan_merges, small_files
from kvstrata.sources.scratch import durable, scratch_path
from kvstrata.sources.tables import file_number, table


OUTPUT = ["db_id", "cf", "file_level", "out_no"]


def _references(spark, d):
    refs, events = manifest_references(table(spark, d, "edits"), table(spark, d, "filter_blocks"))
    return refs, life_spans(events)


def p1_found(spark, d):
    """Orphan references of the manifest and of the filter blocks."""
    return orphans(*_references(spark, d)).select("ref_table", "ref_field", F.col("scope").alias("db_id"), F.col("ref_no").cast("long").alias("ref_no")).distinct()


def p1_counts(spark, d):
    """References and orphans per table and month."""
    return orphan_counts(*_references(spark, d))


def _merge_plan(spark, d):
    return plan_merges(small_files(live_files(table(spark, d, "edits")), table(spark, d, "files"), table(spark, d, "level_targets")))


def p2_found(spark, d):
    """Live small files that can be merged with another."""
    return _merge_plan(spark, d).select("db_id", "file_number").distinct()


def p2_outputs(spark, d):
    """Planned output files: inputs, bytes, entries."""
    return _merge_plan(spark, d).groupBy(*OUTPUT).agg(F.count("*").alias("n_inputs"), F.sum("file_size").alias("n_bytes"), F.sum("num_entries").alias("n_entries"))


def p2_totals(spark, d):
    """What the planned outputs of a database, family and level hold together: every input's bytes and entries once."""
    return _merge_plan(spark, d).groupBy("db_id", "cf", "file_level").agg(F.count("*").alias("n_inputs"), F.sum("file_size").alias("n_bytes"), F.sum("num_entries").alias("n_entries"))


def p2_concatenated(spark, d):
    """All planned small files, of every level, joined byte by byte into the planned outputs, and put in their place.

    The tables describe files but do not hold their bytes, so each planned file is first stored with a header and a line per entry."""
    plan = durable(_merge_plan(spark, d))
    files = FileSet(spark, scratch_path(spark))
    files.add(described_files(plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "db_id", "file_number")))
    out = files.merge(plan.withColumn("name", F.concat_ws("-", "db_id", "file_number")), OUTPUT, "file_number", "lines", header=True)
    return out.select(*OUTPUT, "n_parts", F.col("entries").alias("n_entries"), "n_bytes")


def _seen(spark, d):
    history = table(spark, d, "kv_log").select("db_id", "cf", "user_key")
    return seen_before(history, table(spark, d, "probe_keys").select("probe_no", "db_id", "cf", "user_key"), ["user_key"], ["db_id", "cf"], "probe_no")


def p2_unmatched(spark, d):
    """Planned flushed files whose operations found in the log are not as many as their entries."""
    plan = durable(_merge_plan(spark, d))
    held = flushed_entries(plan, table(spark, d, "files"), table(spark, d, "kv_log"))
    both = plan.where("file_level = 0").join(held.hint("merge"), ["db_id", "file_number"], "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    return both.where("NOT num_entries <=> entries").select("db_id", "file_number", "num_entries", "entries")


def p3_found(spark, d):
    """Incoming keys that occurred before."""
    return _seen(spark, d).where("seen").select("probe_no").distinct()


def p3_wrong_answers(spark, d):
    """The filter's rate of wrong answers, measured and derived."""
    return wrong_answers(_seen(spark, d))


def p3_answers(spark, d):
    """Incoming keys, those seen before, and seen ones that the filter missed (it must miss none), per database and family."""
    by = _seen(spark, d).groupBy("db_id", "cf")
    return by.agg(F.count("*").alias("n_incoming"), F.count_if("seen").alias("n_seen"), F.count_if(F.col("seen") & ~F.col("perhaps")).alias("n_missed"))


def _positions(spark, d):
    """Operations and file revisions in one form: (rec_table, db_id, scope, rec_no, meta_rev) identify a record, (log, seq) is its position."""
    ops = table(spark, d, "kv_log").select(F.lit("kv_log").alias("rec_table"), "db_id", "cf", F.col("cf").alias("scope"), F.col("seqno").alias("rec_no"), F.lit(0).alias("meta_rev"), F.col("log_number").alias("log"), F.col("seqno").alias("seq"))
    files = table(spark, d, "files").select(F.lit("files").alias("rec_table"), "db_id", "cf", F.lit(None).cast("int").alias("scope"), file_number("packed_number_and_path_id").alias("rec_no"), "meta_rev", F.col("log_number").alias("log"), F.col("largest_seqno").alias("seq"))
    return ops.unionByName(files)


def _ledger(spark, d):
    """(incremental state that the succeeded runs of the ledger left, all records): a fresh state folder with one published version."""
    records = _positions(spark, d)
    state = IncrementalTable(spark, scratch_path(spark), ["rec_table", "db_id", "scope", "rec_no", "meta_rev"], F.col("rec_no"), part=F.xxhash64("rec_table", "db_id", "scope"), by_key=True)
    state.adopt(covered_rows(records, durable(covered_positions(table(spark, d, "ingest_runs"))), "log", "seq"))
    return state, records


def p4_found(spark, d):
    """Operations and file revisions that no succeeded run has covered: what the next run reads, published with its tree."""
    state, records = _ledger(spark, d)
    out = state.run(records).select("rec_table", "db_id", "cf", "rec_no")
    return out.where("rec_table = 'kv_log'").unionByName(out.where("rec_table = 'files'").distinct())


def p4_second_run(spark, d):
    """Records of two runs, the first after the ledger and one without changes, and whether the descent came down to the leaves."""
    state, records = _ledger(spark, d)
    counts = []
    for run in (1, 2):
        counts.append((run, state.run(records).count(), 0 in state.levels_read))
    return spark.createDataFrame(counts, "run int, n_records long, leaves_read boolean")


def p5_found(spark, d):
    """Live keys with the sequence number in force, and live files with the edit in force."""
    keys = live_keys(table(spark, d, "kv_log")).select(F.lit("kv_log").alias("feed"), "db_id", "cf", F.col("user_key").alias("item"), F.col("seqno").alias("change_no"))
    files = live_files(table(spark, d, "edits")).select(F.lit("edits").alias("feed"), "db_id", "cf", F.col("file_number").cast("string").alias("item"), F.col("edit_no").alias("change_no"))
    return keys.unionByName(files)


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_outputs, p2_totals, p2_concatenated, p2_unmatched, p3_found, p3_answers, p3_wrong_answers, p4_found, p4_second_run, p5_found)}

_FILE = "(packed_number_and_path_id & 4611686018427387903)"

_CHANGES = f"""
changes AS (SELECT db_id, edit_no, max(kind) AS kind, max(cf) AS cf, max({_FILE}) AS file, max(edit_ts) AS edit_ts FROM edits GROUP BY 1, 2),
blocks AS (SELECT block_no, max(db_id) AS db_id, max({_FILE}) AS file, max(edit_no) AS edit_no, max(built_at) AS built_at FROM filter_blocks GROUP BY 1),
fe AS (SELECT db_id, file, edit_no, kind FROM changes WHERE kind IN ('ADD_FILE', 'DEL_FILE')),
ce AS (SELECT db_id, cf, edit_no, kind FROM changes WHERE kind IN ('ADD_CF', 'DROP_CF')),
a AS (SELECT edit_no, db_id, edit_ts FROM (SELECT *, lag(kind) OVER (PARTITION BY db_id, file ORDER BY edit_no) AS before FROM changes WHERE kind IN ('ADD_FILE', 'DEL_FILE')) x
      WHERE kind = 'DEL_FILE' AND before IS DISTINCT FROM 'ADD_FILE'),
b AS (SELECT r.edit_no, r.db_id, any_value(r.edit_ts) AS edit_ts FROM changes r LEFT JOIN ce ON ce.db_id = r.db_id AND ce.cf = r.cf AND ce.edit_no < r.edit_no
      WHERE r.kind <> 'ADD_CF' AND r.cf <> 0 GROUP BY r.db_id, r.edit_no HAVING arg_max(ce.kind, ce.edit_no) IS DISTINCT FROM 'ADD_CF'),
c AS (SELECT k.block_no, k.db_id, any_value(k.built_at) AS built_at FROM blocks k LEFT JOIN fe ON fe.db_id = k.db_id AND fe.file = k.file AND fe.edit_no <= k.edit_no
      WHERE k.file IS NOT NULL GROUP BY k.db_id, k.block_no HAVING arg_max(fe.kind, fe.edit_no) IS DISTINCT FROM 'ADD_FILE'),
found AS (
  SELECT 'edits' AS ref_table, 'deleted_files' AS ref_field, db_id, edit_no AS ref_no, edit_ts AS ts FROM a
  UNION ALL SELECT 'edits', 'column_family', db_id, edit_no, edit_ts FROM b
  UNION ALL SELECT 'filter_blocks', 'packed_number_and_path_id', db_id, block_no, built_at FROM c)"""

_LIVE_FILES = f"""
ev AS (SELECT DISTINCT db_id, {_FILE} AS file, edit_no, kind, cf, file_level FROM edits WHERE kind IN ('ADD_FILE', 'DEL_FILE')),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, file ORDER BY edit_no DESC) AS rn FROM ev) x WHERE rn = 1 AND kind = 'ADD_FILE')"""

_SMALL = f"""
sizes AS (SELECT db_id, {_FILE} AS file, arg_max(file_size, meta_rev) AS file_size, arg_max(num_entries, meta_rev) AS num_entries FROM files WHERE file_size >= 0 GROUP BY 1, 2),
small AS (SELECT l.db_id, l.cf, l.file_level, l.file, s.file_size, s.num_entries FROM live l JOIN sizes s ON s.db_id = l.db_id AND s.file = l.file JOIN level_targets t ON t.file_level = l.file_level
          WHERE 4 * s.file_size < t.target_file_bytes)"""

_PLAN = f"""
{_LIVE_FILES}, {_SMALL},
tot AS (SELECT s.*, t.target_file_bytes AS target, count(*) OVER g AS n, CAST(sum(file_size) OVER g AS BIGINT) AS total, CAST(sum(file_size) OVER (PARTITION BY s.db_id, s.cf, s.file_level ORDER BY s.file) - file_size AS BIGINT) AS before
        FROM small s JOIN level_targets t ON t.file_level = s.file_level WINDOW g AS (PARTITION BY s.db_id, s.cf, s.file_level)),
outs AS (SELECT *, greatest(1, (2 * total + target) // (2 * target)) AS outputs FROM tot WHERE n > 1),
plan AS (SELECT *, CAST(CASE WHEN total > 0 THEN least(outputs - 1, floor(before / (total / outputs))) ELSE 0 END AS BIGINT) AS out_no FROM outs)"""

_COVERED = r"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY reported_at DESC NULLS LAST, report_no DESC) AS rn FROM ingest_runs) x WHERE rn = 1),
done AS (SELECT db_id, cf, log_number AS lg, last_sequence AS sq FROM last
         WHERE lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'succeeded' AND log_number IS NOT NULL AND last_sequence IS NOT NULL),
cov AS (SELECT db_id, cf, lg, sq FROM (SELECT *, row_number() OVER (PARTITION BY db_id, cf ORDER BY lg DESC, sq DESC) AS rn FROM done) x WHERE rn = 1)"""

_UNCOVERED = f"""ops AS (SELECT k.db_id, k.cf, k.seqno FROM kv_log k LEFT JOIN cov c ON c.db_id = k.db_id AND c.cf = k.cf
        GROUP BY 1, 2, 3 HAVING NOT coalesce(bool_or(k.log_number < c.lg OR (k.log_number = c.lg AND k.seqno <= c.sq)), false)),
fs AS (SELECT f.db_id, max(f.cf) AS cf, {_FILE} AS file, f.meta_rev FROM files f LEFT JOIN cov c ON c.db_id = f.db_id AND c.cf = f.cf
       GROUP BY 1, 3, 4 HAVING NOT coalesce(bool_or(f.log_number < c.lg OR (f.log_number = c.lg AND f.largest_seqno <= c.sq)), false))"""

_ASKED = """p AS (SELECT DISTINCT probe_no, db_id, cf, user_key FROM probe_keys WHERE user_key IS NOT NULL),
f AS (SELECT *, min(probe_no) OVER (PARTITION BY db_id, cf, user_key) AS first_no FROM p),
k AS (SELECT DISTINCT db_id, cf, user_key FROM kv_log WHERE user_key IS NOT NULL)"""

ORACLE_SQL = {
    "p1_found": f"WITH {_CHANGES} SELECT DISTINCT ref_table, ref_field, db_id, ref_no FROM found",
    "p1_counts": f"""WITH {_CHANGES},
refs AS (
  SELECT 'edits' AS ref_table, 'deleted_files' AS ref_field, strftime(edit_ts, '%Y-%m') AS period FROM changes WHERE kind = 'DEL_FILE' AND file IS NOT NULL
  UNION ALL SELECT 'edits', 'column_family', strftime(edit_ts, '%Y-%m') FROM changes WHERE kind <> 'ADD_CF' AND cf <> 0
  UNION ALL SELECT 'filter_blocks', 'packed_number_and_path_id', strftime(built_at, '%Y-%m') FROM blocks WHERE file IS NOT NULL),
n AS (SELECT ref_table, ref_field, period, count(*) AS n_refs FROM refs GROUP BY ALL),
m AS (SELECT ref_table, ref_field, strftime(ts, '%Y-%m') AS period, count(*) AS n_orphans FROM found GROUP BY ALL)
SELECT n.ref_table, n.ref_field, n.period, CAST(n.n_refs AS BIGINT) AS n_refs, CAST(coalesce(m.n_orphans, 0) AS BIGINT) AS n_orphans
FROM n LEFT JOIN m ON m.ref_table = n.ref_table AND m.ref_field = n.ref_field AND m.period IS NOT DISTINCT FROM n.period""",
    "p2_found": f"""WITH {_LIVE_FILES}, {_SMALL}
SELECT DISTINCT db_id, file AS file_number FROM (SELECT *, count(*) OVER (PARTITION BY db_id, cf, file_level) AS n FROM small) x WHERE n > 1""",
    "p2_totals": f"""WITH {_LIVE_FILES}, {_SMALL}
SELECT db_id, cf, file_level, CAST(count(*) AS BIGINT) AS n_inputs, CAST(sum(file_size) AS BIGINT) AS n_bytes, CAST(sum(num_entries) AS BIGINT) AS n_entries FROM small GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "p2_outputs": f"""WITH {_PLAN} SELECT db_id, cf, file_level, out_no, CAST(count(*) AS BIGINT) AS n_inputs, CAST(sum(file_size) AS BIGINT) AS n_bytes, CAST(sum(num_entries) AS BIGINT) AS n_entries FROM plan GROUP BY 1, 2, 3, 4""",
    "p2_concatenated": f"""WITH {_PLAN},
line AS (SELECT file, db_id, sum(strlen(db_id || ' ' || file || ' ' || i) + 1) AS b FROM (SELECT db_id, file, unnest(range(num_entries)) AS i FROM plan) x GROUP BY 1, 2)
SELECT p.db_id, p.cf, p.file_level, p.out_no, CAST(count(*) AS BIGINT) AS n_parts, CAST(coalesce(sum(p.num_entries), 0) AS BIGINT) AS n_entries, CAST(strlen('db file entry') + 1 + coalesce(sum(l.b), 0) AS BIGINT) AS n_bytes
FROM plan p LEFT JOIN line l ON l.db_id = p.db_id AND l.file = p.file GROUP BY 1, 2, 3, 4""",
    "p2_unmatched": f"""WITH {_PLAN}, rng AS (SELECT db_id, {_FILE} AS file, min(smallest_seqno) AS lo, max(largest_seqno) AS hi FROM files GROUP BY 1, 2),
ops AS (SELECT DISTINCT db_id, cf, seqno FROM kv_log WHERE tp <> 3 AND user_key IS NOT NULL),
held AS (SELECT p.db_id, p.file, any_value(p.num_entries) AS num_entries, count(o.seqno) AS entries FROM plan p LEFT JOIN rng r ON r.db_id = p.db_id AND r.file = p.file
  LEFT JOIN ops o ON o.db_id = p.db_id AND o.cf = p.cf AND o.seqno BETWEEN r.lo AND r.hi WHERE p.file_level = 0 GROUP BY 1, 2)
SELECT db_id, file AS file_number, num_entries, CAST(entries AS BIGINT) AS entries FROM held WHERE num_entries IS DISTINCT FROM entries""",
    "p3_answers": f"""WITH {_ASKED}
SELECT f.db_id, f.cf, CAST(count(*) AS BIGINT) AS n_incoming, CAST(count(*) FILTER (WHERE k.user_key IS NOT NULL OR f.first_no < f.probe_no) AS BIGINT) AS n_seen, CAST(0 AS BIGINT) AS n_missed
FROM f LEFT JOIN k ON k.db_id = f.db_id AND k.cf = f.cf AND k.user_key = f.user_key GROUP BY 1, 2""",
    "p3_found": f"""WITH {_ASKED}
SELECT DISTINCT f.probe_no FROM f LEFT JOIN k ON k.db_id = f.db_id AND k.cf = f.cf AND k.user_key = f.user_key WHERE k.user_key IS NOT NULL OR f.first_no < f.probe_no""",
    "p4_found": f"""WITH {_COVERED}, {_UNCOVERED} SELECT 'kv_log' AS rec_table, db_id, cf, seqno AS rec_no FROM ops UNION ALL SELECT DISTINCT 'files', db_id, cf, file FROM fs""",
    "p4_second_run": f"""WITH {_COVERED}, {_UNCOVERED} SELECT 1 AS run, CAST((SELECT count(*) FROM ops) + (SELECT count(*) FROM fs) AS BIGINT) AS n_records, true AS leaves_read UNION ALL SELECT 2, 0, false""",
    "p5_found": f"""WITH {_LIVE_FILES},
kv AS (SELECT DISTINCT db_id, cf, user_key, seqno, tp FROM kv_log WHERE tp IN (0, 1, 4, 5) AND user_key IS NOT NULL),
newest AS (SELECT *, row_number() OVER (PARTITION BY db_id, cf, user_key ORDER BY seqno DESC) AS rn FROM kv)
SELECT 'kv_log' AS feed, db_id, cf, user_key AS item, seqno AS change_no FROM newest WHERE rn = 1 AND tp IN (1, 5)
UNION ALL SELECT 'edits', db_id, cf, CAST(file AS VARCHAR), edit_no FROM live""",
}
