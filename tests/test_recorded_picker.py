"""The picker's queries over recorded files: every database and family, by its latest revisions."""

import pytest

import __spark_entry__ as entry
from helpers import FILES, duck, rows
from picker_sets import PICKER_SETS

NAMES = ["level_targets", "compaction_score", "pick_level", "pick_files", "expand_inputs"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Set A6.2 as families 0 and null of database 1, A7.2 as one of database 2 (where file 5 was at level 3 once), and A7.2 with a busy output file in 3."""
    d = str(tmp_path_factory.mktemp("recorded"))
    put = lambda db, cf, name, busy=(): [(db, i + (100 if cf is None else 0), cf, level, size, lo, hi, 1, 1, 1, 0, i in busy, 1, 1, None) for i, size, level, lo, hi in PICKER_SETS[name][2]]
    files = put(1, 0, "A6.2") + put(1, None, "A6.2") + put(2, 1, "A7.2") + [(2, 5, 1, 3, 9000, "150", "180", 1, 1, 1, 0, False, 0, 1, None), (2, 9, 1, 5, -1, "500", "510", 1, 1, 1, 0, False, 1, 1, None)]
    files += put(3, 1, "A7.2", busy={2}) + [(3, 12, 1, 6, 1, "150", "160", 1, 1, 1, 0, True, 1, 1, None)]
    spark.createDataFrame(files, FILES).write.parquet(f"{d}/files.parquet")
    limits = [(0, None), *[(level, 200 * 10 ** (level - 1)) for level in range(1, 6)], (6, None)]
    spark.createDataFrame([(level, 1, most) for level, most in limits], "file_level int, target_file_bytes long, max_level_bytes long").write.parquet(f"{d}/level_targets.parquet")
    return d


def test_inputs_of_each_group(spark, made):
    run = {n: entry.queries()[n](spark, made) for n in NAMES}
    groups = {(1, 0), (1, None), (2, 1), (3, 1)}
    assert {(r.db_id, r.cf) for r in run["level_targets"].collect()} == groups
    picks = {(r.db_id, r.cf): (r.level, r.output_level) for r in run["pick_level"].collect()}
    assert picks == {(1, 0): (0, 6), (1, None): (0, 6), (2, 1): (5, 6), (3, 1): (5, 6)}
    got: dict = {}
    for r in run["expand_inputs"].collect():
        got.setdefault((r.db_id, r.cf), set()).add(r.file_id)
    assert got == {(1, 0): set(range(4, 12)), (1, None): set(range(104, 112)), (2, 1): {5}, (3, 1): {4, 7}}


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, made, name):
    df = entry.queries()[name](spark, made)
    rel = duck(made).execute(entry.oracle_sql()[name])
    cols = [x[0] for x in rel.description]
    assert rows(df, *cols) == sorted((tuple(r) for r in rel.fetchall()), key=repr)
