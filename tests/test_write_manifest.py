from pyspark.sql import functions as F

from helpers import EDITS, FILES, LOG, edit, file_row, op, rows
from kvstrata.operators import manifest, write
from kvstrata.operators.ordering import key_ranks, running_total

OPS = "batch_id long, ordinal long, cf int, key string, op string, value string"


def test_sequences_and_watermark(spark):
    sizes = {0: 3, 1: 1, 2: 4, 70_000: 2, 140_001: 5}
    ops = spark.createDataFrame([(b, i, 0, f"k{i}", "PUT", "v") for b, n in sizes.items() for i in range(n)], OPS)
    assert rows(write.assign_sequence(ops, 10)) == [(0, 11, 13, 3), (1, 14, 14, 1), (140_001, 21, 25, 5), (2, 15, 18, 4), (70_000, 19, 20, 2)]
    assert sorted(r.seq for r in write.number_operations(ops).collect()) == list(range(1, 16))
    assigned = write.assign_sequence(ops)
    assert rows(write.commit_watermark(ops.where("batch_id <> 2"), assigned)) == [(1, 4)]
    assert rows(write.commit_watermark(ops, assigned)) == [(140_001, 15)]
    assert rows(write.commit_watermark(ops.where("batch_id <> 0"), assigned)) == [(None, None)]


def test_running_total_and_ranks(spark):
    df = spark.range(0, 1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.t for r in running_total(df, "id", F.col("v"), "t", 64).collect()}
    total, want = 0, {}
    for i in range(1000):
        total += i % 7
        want[i] = total
    assert got == want
    keys = spark.createDataFrame([(g, k) for g in (0, 1) for k in ("a", "ab", "b", "ba", "bb", "é", "")], "g int, k string")
    order = sorted(("a", "ab", "b", "ba", "bb", "é", ""), key=str.encode)
    assert rows(key_ranks(keys, ["g"], "k", ranges=3), "g", "k", "key_rank") == sorted(((g, k, order.index(k)) for g in (0, 1) for k in order), key=repr)


def test_global_sequence(spark):
    kv = spark.createDataFrame([(0, "a", 5, "PUT", "x"), (0, "b", 9, "PUT", "y")], "cf int, key string, seq long, op string, value string")
    outside = spark.createDataFrame([(0, "a", "PUT", "new"), (0, "b", "DEL", None)], "cf int, key string, op string, value string")
    assert rows(write.ingest_global_sequence(kv, outside), "key", "seq", "value") == sorted([("a", 5, "x"), ("b", 9, "y"), ("a", 10, "new"), ("b", 10, None)], key=repr)


def test_replay_and_checkpoint(spark):
    edits = [edit(1, 1, "ADD_CF", cf=1)] + [edit(1, n, "ADD_FILE", n) for n in range(2, 7)] + [edit(1, 9, "DEL_FILE", 3), edit(1, 10, "ADD_FILE", 3, level=1), edit(1, 11, "DEL_FILE", 5)]
    edits += [edit(1, 12, "ADD_FILE", 20, cf=1), edit(1, 13, "DROP_CF", cf=1), edit(1, 11, "DEL_FILE", 5)]
    df = spark.createDataFrame(edits, EDITS)
    live = rows(manifest.replay(df), "file_number", "file_level", "edit_no")
    assert live == [(2, 0, 2), (3, 1, 10), (4, 0, 4), (6, 0, 6)]
    for cut in (0, 5, 10, 99):
        base = manifest.checkpoint(df, cut)
        assert rows(manifest.replay_from(base, df.where(F.col("edit_no") > cut)), "file_number") == [(2,), (20,), (3,), (4,), (6,)]
    assert rows(write.family_catalog(df)) == []
    assert rows(manifest.counters(df), "db_id", "next_file") == [(1, 21)]


def test_logs_and_obsolete(spark):
    edits = spark.createDataFrame([edit(1, 1, "SET_LOG", cf=0, log=5), edit(1, 2, "SET_LOG", cf=1, log=3), edit(1, 3, "ADD_FILE", 7)], EDITS)
    log = spark.createDataFrame([op(1, 0, "a", 1, 1, 2), op(1, 0, "a", 2, 1, 5), op(1, 1, "b", 3, 1, 3), op(1, 0, None, 4, 3, 9), op(1, 0, "a", 1, 1, 6)], LOG)
    assert rows(manifest.removable_logs(edits, log)) == [(1, 2)]
    assert rows(manifest.replayed_operations(edits, log)) == [(1, 0, 2), (1, 1, 1)]
    files = spark.createDataFrame([file_row(1, 7), file_row(1, 8), file_row(1, (1 << 62) | 7), file_row(1, None)], FILES)
    assert rows(manifest.obsolete_files(edits, files)) == [(1, 8)]
    assert rows(manifest.level_stats(manifest.latest_files(spark.createDataFrame([file_row(1, 7, size=5), file_row(1, 7, size=None, rev=1), file_row(1, 8, size=4)], FILES)), ["cf"])) == [(0, 0, 2, 4)]
