"""Replay of a manifest: which files and families are live, statistics, log retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.operators.changes import current_state, live_files, null_safe_join
from kvstrata.operators.write import family_catalog
from kvstrata.sources.tables import file_number

FILE_STATE = ["db_id", "cf", "file_level", "file_number", "edit_no"]


def _of_live_families(live: DataFrame, edits: DataFrame) -> DataFrame:
    """Without the files of families whose last change is a drop."""
    touched = edits.where(F.col("kind").isin("ADD_CF", "DROP_CF") & F.col("cf").isNotNull()).select("db_id", "cf").distinct()
    dropped = touched.join(family_catalog(edits), ["db_id", "cf"], "left_anti")
    return live.join(dropped, ["db_id", "cf"], "left_anti").select(*FILE_STATE)


def replay(edits: DataFrame) -> DataFrame:
    """Live files of live families, from all edits."""
    return _of_live_families(live_files(edits), edits)


def checkpoint(edits: DataFrame, up_to: int) -> DataFrame:
    """The live files after the edits up to a number: the rows that a rolled manifest begins with."""
    return live_files(edits.where(F.col("edit_no") <= up_to)).select(*FILE_STATE)


def replay_from(base: DataFrame, edits: DataFrame) -> DataFrame:
    """The live files from a checkpoint and the edits after it; equals the replay of everything."""
    later = edits.where(F.col("kind").isin("ADD_FILE", "DEL_FILE") & F.col("packed_number_and_path_id").isNotNull()).withColumn("file_number", file_number("packed_number_and_path_id"))
    return current_state(later, ["db_id", "file_number"], "edit_no", F.col("kind") == "ADD_FILE", ["cf", "file_level"], base=base).select(*FILE_STATE)


def apply_version(old: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The old files without the removed ones (db_id, file_number), and the added ones."""
    return null_safe_join(old, removed.select("db_id", "file_number").distinct(), ["db_id", "file_number"], "left_anti").unionByName(added.select(old.columns))


def latest_files(files: DataFrame) -> DataFrame:
    """The metadata of each file as of its highest revision, with file_number."""
    numbered = files.withColumn("file_number", file_number("packed_number_and_path_id"))
    rest = [c for c in files.columns if c not in ("db_id", "meta_rev", "packed_number_and_path_id")]
    last = numbered.groupBy("db_id", "file_number").agg(F.max(F.struct("meta_rev", *rest)).alias("m"))
    return last.select("db_id", "file_number", "m.*")


def level_stats(files: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes per level; unknown sizes (null or negative) count as 0 bytes."""
    size = F.when(F.col("file_size") > 0, F.col("file_size")).otherwise(0)
    return files.groupBy(*by, "file_level").agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("n_bytes"))


def family_logs(edits: DataFrame) -> DataFrame:
    """(db_id, cf, log_number): the first log that each family still needs, as last set."""
    return edits.where("log_number > 0 AND cf IS NOT NULL").groupBy("db_id", "cf").agg(F.max("log_number").alias("log_number"))


def removable_logs(edits: DataFrame, kv_log: DataFrame) -> DataFrame:
    """(db_id, log_number) of logs that no family of the database needs."""
    kept = family_logs(edits).groupBy("db_id").agg(F.min("log_number").alias("least"))
    logs = kv_log.where("log_number IS NOT NULL").select("db_id", "log_number").distinct()
    return logs.join(kept, "db_id").where("log_number < least").select("db_id", "log_number")


def replayed_operations(edits: DataFrame, kv_log: DataFrame) -> DataFrame:
    """(db_id, cf, n_ops): operations of logs at or after the family's log number; a repeated operation counts once, with its latest log."""
    ops = kv_log.where("tp <> 3").groupBy("db_id", "cf", "seqno").agg(F.max("log_number").alias("op_log"))
    need = family_logs(edits)
    return ops.join(need, ["db_id", "cf"]).where("op_log >= log_number").groupBy("db_id", "cf").agg(F.count("*").alias("n_ops"))


def counters(edits: DataFrame) -> DataFrame:
    """(db_id, next_file, last_sequence, max_cf, max_log): where a database's counters stand after all edits."""
    number = F.coalesce(F.max(file_number("packed_number_and_path_id")), F.lit(0)) + 1
    return edits.groupBy("db_id").agg(number.alias("next_file"), F.max("last_sequence").alias("last_sequence"), F.coalesce(F.max("cf"), F.lit(0)).alias("max_cf"), F.max("log_number").alias("max_log"))


def obsolete_files(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(db_id, file_number) of recorded files that no live version holds."""
    known = files.where("packed_number_and_path_id IS NOT NULL").select("db_id", file_number("packed_number_and_path_id").alias("file_number")).distinct()
    return null_safe_join(known, live_files(edits).select("db_id", "file_number"), ["db_id", "file_number"], "left_anti")
