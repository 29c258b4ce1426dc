import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.operators import compact, read
from kvstrata.sources.kv import KV_SCHEMA


def model(log, snapshot=None):
    out = {}
    for cf, key, seq, op, value in sorted((x for x in log if x[1] is not None and x[2] is not None), key=lambda x: (x[2], x[3])):
        if snapshot is None or seq <= snapshot:
            out[cf, key] = (seq, op, value)
    return sorted((cf, k, s, v) for (cf, k), (s, op, v) in out.items() if op == "PUT")


def log(n=400, seed=1):
    r = random.Random(seed)
    return [(r.randrange(2), f"k{r.randrange(30):03}", s, op := r.choice(["PUT", "PUT", "DEL"]), f"v{s}" if op == "PUT" else None) for s in range(1, n)]


def test_deleted_key_is_absent_and_clean(spark):
    kv = spark.createDataFrame([(0, "key1", 1, "PUT", "value"), (0, "key2", 2, "PUT", "value"), (0, "key1", 3, "DEL", None)], KV_SCHEMA)
    assert read.point_get(kv, 0, "key1").count() == 0
    assert rows(read.point_get(kv, 0, "key1", 2)) == [(0, "key1", 1, "value")]
    assert rows(read.scan(kv)) == [(0, "key2", 2, "value")]


def test_scans_match_a_model(spark):
    data = log()
    kv = spark.createDataFrame(data, KV_SCHEMA)
    for s in (None, 0, 57, 399):
        forward = [tuple(r) for r in read.scan(kv, s).collect()]
        assert forward == model(data, s)
        assert [tuple(r) for r in read.scan(kv, s, reverse=True).collect()] == forward[::-1]
    first = [r for r in model(data) if r[0] == 1]
    assert rows(read.page(kv, 1, 4, F.col("key") > "k003")) == [r for r in first if r[1] > "k003"][:4]
    assert rows(read.page(kv, 1, 4, F.col("key") < "k020", reverse=True)) == [r for r in first if r[1] < "k020"][-4:]
    assert rows(read.seek(kv, 1, "k010x")) == [next(r for r in first if r[1] >= "k010x")]
    assert rows(read.seek(kv, 1, "k010x", reverse=True)) == [[r for r in first if r[1] <= "k010x"][-1]]
    assert read.seek(kv, 1, "z").count() == 0


def test_asof_equals_snapshot_reads(spark):
    data = log(200, 3)
    kv = spark.createDataFrame(data, KV_SCHEMA)
    probes = spark.createDataFrame([(cf, f"k{k:03}", s) for cf in (0, 1) for k in range(0, 40, 3) for s in (5, 80, 500)] + [(0, None, 5), (0, "k000", None)], "cf int, key string, snapshot long")
    want = sorted(((cf, k, s, q, v) for s in (5, 80, 500) for cf, k, q, v in model(data, s) if int(k[1:]) % 3 == 0), key=repr)
    for width in (1 << 16, 7):
        assert rows(read.as_of(kv, probes, width)) == want
    odd = spark.createDataFrame([(None, "a", 1, "PUT", "x"), (0, "a", 2, "PUT", None), (0, "a", 2, "PUT", None), (0, "a", None, "PUT", "n")], KV_SCHEMA)
    asked = spark.createDataFrame([(None, "a", 9), (0, "a", 2), (0, "a", 1), (0, "a", 2)], "cf int, key string, snapshot long")
    assert rows(read.as_of(odd, asked)) == sorted([(None, "a", 9, 1, "x"), (0, "a", 2, 2, None)], key=repr)


def test_nulls_repeats_and_empty(spark):
    data = [(0, None, 1, "PUT", "x"), (0, "a", None, "PUT", "x"), (None, "a", 2, "PUT", None), (0, "a", 3, "PUT", ""), (0, "a", 3, "PUT", "")]
    kv = spark.createDataFrame(data, KV_SCHEMA)
    assert rows(read.scan(kv)) == [(0, "a", 3, ""), (None, "a", 2, None)]
    empty = spark.createDataFrame([], KV_SCHEMA)
    assert read.scan(empty).count() == read.page(empty, 0, 3).count() == compact.compact(empty, [5], True).count() == 0
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a")], "cf int, key string")
    assert rows(read.multi_get(kv, asked)) == [(0, "a", 3, "", True), (0, "b", None, None, False)]


GOLDEN = {(): 1000, (12,): 1500, (14,): 1250, (10, 14): 2250}


def test_compaction_golden_counts(spark):
    data = []
    for i in range(1000):
        key = f"test_compaction-{i}"
        data += [(0, key, 10, "PUT", "v0"), (0, key, 12, "PUT", "v1")]
        if i % 2 == 0:
            data.append((0, key, 14, "DEL", None))
        if i % 4 == 0:
            data.append((0, key, 16, "PUT", "v3"))
    kv = spark.createDataFrame(data, KV_SCHEMA).cache()
    for snapshots, n in GOLDEN.items():
        assert compact.compact(kv, list(snapshots)).count() == n
    bottom = compact.compact(kv, [14], bottommost=True)
    assert bottom.count() == 750 and bottom.where("op = 'DEL'").count() == 0
    four = rows(compact.compact(kv, [10, 14]).where("key = 'test_compaction-4'"), "seq", "op", "value")
    assert four == [(10, "PUT", "v0"), (14, "DEL", None), (16, "PUT", "v3")]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(1, 120), max_size=3))
def test_compaction_keeps_pinned_reads(spark, seed, snapshots):
    kv = spark.createDataFrame(log(120, seed), KV_SCHEMA)
    for bottommost in (False, True):
        out = compact.compact(kv, snapshots, bottommost)
        for s in [*snapshots, None]:
            assert rows(read.scan(out, s)) == rows(read.scan(kv, s))


def test_split_keeps_keys_whole(spark):
    kv = spark.createDataFrame(log(), KV_SCHEMA)
    out = compact.split_files(kv, 40, [50, 200])
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    assert out.select("file_no").distinct().count() > 3 and rows(out.drop("file_no")) == rows(compact.compact(kv, [50, 200]))
    least = out.groupBy("cf", "key", "file_no").agg(F.sum(size).alias("b")).groupBy("cf", "file_no").agg((F.sum("b") - F.max("b")).alias("over")).agg(F.max("over")).first()[0]
    assert least < 40
    assert out.groupBy("cf", "key").agg(F.countDistinct("file_no").alias("n")).where("n > 1").count() == 0
    ordered = sorted(map(tuple, out.groupBy("cf", "file_no").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()))
    assert all(a[3] < b[2] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])
