import random

from pyspark.sql import functions as F

from helpers import EDITS, LOG, edit, op, rows
from kvstrata.operators.changes import batch_limits, current_state, live_files, live_keys


def test_order_repeats_and_late_rows(spark):
    ops = [op(1, 0, "a", 5, 1), op(1, 0, "a", 3, 0), op(1, 0, "a", 5, 1, 9), op(1, 0, "b", 2, 5), op(1, 0, "b", 7, 4), op(1, 1, "b", 4, 1), op(2, 0, "a", 1, 1), op(1, 0, None, 9, 3), op(1, 0, "note", 8, 3)]
    random.Random(1).shuffle(ops)
    df = spark.createDataFrame(ops, LOG)
    for batches in (1, 2, 4, 9):
        assert rows(live_keys(df, batches)) == [(1, 0, "a", 5), (1, 1, "b", 4), (2, 0, "a", 1)]


def test_random_feeds_match_a_dictionary(spark):
    r = random.Random(7)
    ops = [op(r.randrange(3), r.randrange(2), r.choice(["hot"] * 30 + [f"k{i}" for i in range(40)]), s, r.choice([0, 1, 4, 5])) for s in range(1500)]
    want = {}
    for o in ops:
        want[o[:3]] = o[3:5]
    df = spark.createDataFrame(ops + ops[::7], LOG).repartition(5)
    assert rows(live_keys(df)) == sorted(((*k, s) for k, (s, t) in want.items() if t in (1, 5)), key=repr)


def test_null_keys_ties_and_base(spark):
    feed = spark.createDataFrame([(None, 1, True, "x"), (None, 2, True, "y"), ("a", 3, True, "p"), ("a", 3, False, None), ("b", 4, False, None), ("c", None, True, "n")], "k string, no long, put boolean, image string")
    base = spark.createDataFrame([("b", 0, "old"), ("z", 0, "kept"), (None, 0, "old")], "k string, no long, image string")
    assert rows(current_state(feed, ["k"], "no", F.col("put"), ["image"], base)) == sorted([(None, 2, "y"), ("a", 3, "p"), ("z", 0, "kept")], key=repr)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], LOG)
    assert live_keys(empty).count() == 0 and batch_limits(empty, "seqno", 4) == []
    df = spark.createDataFrame([op(1, 0, "a", 5, 1)], LOG).withColumns({c: F.lit(0) for c in ("rank", "is_put", "image", "_right_cf", "r")})
    assert rows(live_keys(df)) == [(1, 0, "a", 5)]


def test_files(spark):
    edits = [edit(1, 1, "ADD_FILE", 7, cf=2, level=0), edit(1, 4, "ADD_FILE", (1 << 62) | 7, cf=2, level=1), edit(1, 2, "DEL_FILE", 7), edit(1, 5, "ADD_FILE", 8), edit(1, 6, "DEL_FILE", -(1 << 63) | 8), edit(1, 7, "ADD_FILE", None), edit(1, 8, "SET_LOG", log=3)]
    df = spark.createDataFrame(edits + edits[:2], EDITS)
    assert rows(live_files(df)) == [(1, 7, 4, 2, 1)]
    assert live_files(df.limit(0)).count() == 0
