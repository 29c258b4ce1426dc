import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import RUNS, rows
from kvstrata.operators.incremental import IncrementalTable, changed_leaves, covered_positions, covered_rows, tree_of
from kvstrata.sources.scratch import durable

TREE = "part long, leaf long, digest long"


def at(h):
    return dt.datetime(2024, 1, 1, h)


def test_descent_finds_exactly_the_changed_leaves(spark):
    r = random.Random(1)
    for top in (3, 500, 100_000):
        now = {(p, r.randrange(top)): r.randrange(10**9) for p in (1, 2) for _ in range(200)}
        then = dict(now)
        changed = r.sample(sorted(now), 5)
        for k in changed[:3]:
            then[k] += 1
        for k in changed[3:]:
            del then[k]
        then[1, top + 7] = 1
        trees = [durable(tree_of(spark.createDataFrame([(*k, v) for k, v in t.items()], TREE))) for t in (now, then)]
        found, looked = changed_leaves(*trees)
        assert rows(found) == sorted({*changed, (1, top + 7)}, key=repr) and looked[-1] == 0
        same, looked = changed_leaves(trees[0], trees[0])
        assert same.count() == 0 and len(looked) == 1 and looked[0] > 0  # equal roots end the descent
    empty = durable(tree_of(spark.createDataFrame([], TREE)))
    assert changed_leaves(empty, empty)[0].count() == 0
    assert changed_leaves(trees[0], empty)[0].count() == len(now)


def test_only_latest_reports_count(spark):
    runs = [(1, 1, 1, 0, "succeeded", 5, 50, at(0), at(1)), (1, 2, 1, 0, "FAILED", 9, 90, at(0), at(2)), (2, 1, 1, 0, " Succeeded\t", 3, 30, None, at(1)), (3, 1, 1, 0, "succeeded_partial", 8, 80, None, at(1)),
            (4, 1, 1, 0, "succeeded", None, 80, None, at(1)), (5, 1, 1, 1, "SUCCEEDED", 2, 9, None, at(3)), (5, 2, 1, 1, None, 7, 9, None, at(1)), (6, 1, 1, 1, None, 7, 9, None, at(1))]
    assert rows(covered_positions(spark.createDataFrame(runs + runs[:3], RUNS))) == [(1, 0, 3, 30), (1, 1, 2, 9)]


POSITIONS = "db_id int, cf int, seqno long, log long, at long"


def test_adopted_positions(spark, tmp_path):
    """Records that the ledger's positions cover are done, by any of their rows; the rest comes once, and then no more."""
    r = random.Random(4)
    log = [(d, c, s, r.randrange(1, 6), s) for d in (1, 2) for c in (0, 1) for s in range(c * 10_000 + 1, c * 10_000 + 800)]
    log += [(1, 0, 1, 99, 1), (1, 0, 5000, None, 5000), (None, 0, 3, 1, 3), (1, None, 4, 1, 4), (1, 0, None, 3, None), *log[::9]]
    runs = spark.createDataFrame([(1, 1, 1, 0, "succeeded", 3, 400, None, at(1)), (2, 1, 2, 1, "succeeded", 5, 10**6, None, at(1))], RUNS)
    pos = {(1, 0): (3, 400), (2, 1): (5, 10**6)}
    done = {x[:3] for x in log if None not in x and x[:2] in pos and x[3:] <= pos[x[:2]]}
    df = spark.createDataFrame(log, POSITIONS).withColumns({c: F.lit(1) for c in ("seq", "leaf", "digest", "part", "node", "level")})
    t = IncrementalTable(spark, f"file://{tmp_path}/state", ["db_id", "cf", "seqno"], F.col("seqno"), leaf_width=64, part=F.xxhash64("db_id", "cf"), by_key=True)
    t.adopt(covered_rows(df, durable(covered_positions(runs)), "log", "at"))
    with pytest.raises(ValueError):
        t.adopt(df)
    got = t.run(df)
    assert rows(got, "db_id", "cf", "seqno") == sorted({x[:3] for x in log} - done, key=repr) and 0 in t.levels_read
    assert t.run(df).count() == 0 and 0 not in t.levels_read
    late = df.unionByName(spark.createDataFrame([(1, 0, 7777, 1, 7777), (2, 0, 5, 9, 5), (3, 3, 1, 1, 1)], POSITIONS), allowMissingColumns=True)
    assert rows(t.run(late), "db_id", "cf", "seqno") == [(1, 0, 7777), (3, 3, 1)]
    assert t.run(late).count() == 0 and t.version() == 5


def test_a_run_that_dies_before_the_rename_repeats_its_records(spark, tmp_path, monkeypatch):
    make = lambda: IncrementalTable(spark, f"file://{tmp_path}/state", ["id"], F.col("id"), leaf_width=16)
    frame = lambda ids: spark.createDataFrame([(i, "v") for i in ids], "id long, v string")
    make().run(frame(range(100)))
    dying = make()

    def killed(document):
        raise RuntimeError("killed")

    monkeypatch.setattr(dying._pointer, "publish", killed)
    with pytest.raises(RuntimeError):
        dying.run(frame(range(120)))  # output, records and tree are written, the rename is not reached
    assert make().version() == 1
    assert rows(make().run(frame(range(130))), "id") == [(i,) for i in range(100, 130)]
    assert make().run(frame(range(130))).count() == 0


def test_records_are_saved_for_changed_leaves_only(spark, tmp_path):
    t = IncrementalTable(spark, f"file://{tmp_path}/state", ["id"], F.col("id"), leaf_width=16)
    t.run(spark.range(10_000))
    assert t.run(spark.range(10_001)).count() == 1
    assert spark.read.parquet(f"{tmp_path}/state/records/at=2").count() < 400
    assert t.run(spark.range(10_002)).count() == 1 and t.run(spark.range(10_002)).count() == 0
    assert rows(t.run(spark.range(5, 10_002)), "id", "_change") == [(i, "delete") for i in range(5)]


def test_runs_publish_output_and_tree_together(spark, tmp_path):
    frame = lambda d: spark.createDataFrame([(k, v, "x") for k, v in d.items()], "id long, v string, _hashlike string")
    t = IncrementalTable(spark, f"file://{tmp_path}/state", ["id"], F.col("id"), leaf_width=16)
    state = {i: f"v{i}" for i in range(200)}
    assert t.run(frame(state)).count() == 200 and t.version() == 1
    assert t.run(frame(state)).count() == 0
    state[5], state[900] = "new", None
    del state[77]
    expected = [(5, "new", "upsert"), (77, None, "delete"), (900, None, "upsert")]
    assert rows(t.run(frame(state), publish=False), "id", "v", "_change") == sorted(expected, key=repr)  # a run that failed before it was published
    again = IncrementalTable(spark, f"file://{tmp_path}/state", ["id"], F.col("id"), leaf_width=16)
    assert rows(again.run(frame(state)), "id", "v", "_change") == sorted(expected, key=repr) and again.version() == 3
    assert again.run(frame(state)).count() == 0
    repeated = frame(state).unionByName(frame({None: "null key"}))
    assert rows(again.run(repeated), "id", "v", "_change") == [(None, "null key", "upsert")]
    assert again.run(repeated.limit(0)).count() == 201 and again.run(repeated.limit(0)).count() == 0
