import __spark_entry__ as entry
from helpers import EDITS, FILES, LOG, edit, file_row, op, rows


def test_flushed_files_without_their_operations_are_reported(spark, tmp_path):
    """File 1 has both of its operations in the log, file 2 one of two, file 3 none."""
    put = lambda name, made, schema: spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("edits", [edit(1, n, "ADD_FILE", n) for n in (1, 2, 3)], EDITS)
    put("files", [file_row(1, n, lo=2 * n, hi=2 * n + 1, entries=2) for n in (1, 2, 3)], FILES)
    put("kv_log", [op(1, 0, "a", s, 1) for s in (2, 3, 4)], LOG)
    put("level_targets", [(0, 65536, None)], "file_level int, target_file_bytes long, max_level_bytes long")
    assert rows(entry.queries()["p2_unmatched"](spark, str(tmp_path))) == [(1, 2, 2, 1), (1, 3, 2, 0)]
