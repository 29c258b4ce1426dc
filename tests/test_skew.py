import random

from pyspark.sql import functions as F

from helpers import rows
from kvstrata.operators import skew
from kvstrata.operators.skew import bitmap, may_be_in, spread_join, thinned


def test_hot_and_cold_keys_join_alike(spark, monkeypatch):
    r = random.Random(1)
    made = [(i, r.choice(["hot"] * 5 + [None] * 3 + [f"k{j}" for j in range(12)]), 1) for i in range(400)]
    df = spark.createDataFrame(made, "id long, k string, n int")
    facts = df.groupBy("k").agg(F.count("*").alias("load"), F.min("id").alias("first")).where("k IS NULL OR k <> 'k3'")
    for parts in (1, 4, 1024):
        monkeypatch.setattr(skew, "PARTS", parts)
        for how in ("inner", "left"):
            for safe in (False, True):
                got = spread_join(df, facts, ["k"], "load", len(made), how, safe)
                first = {k: min(i for i, x, _ in made if x == k) for k in {x for _, x, _ in made} if k != "k3" and (safe or k is not None)}
                want = [(i, k, n, first.get(k)) for i, k, n in made if how == "left" or k in first]
                assert rows(got, "id", "k", "n", "first") == sorted(want, key=repr)
    assert spread_join(df.limit(0), facts.limit(0), ["k"], "load", 0).count() == 0


def test_bitmaps_never_miss_and_are_bounded(spark, monkeypatch):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(None, None)], "id long, h long"))
    wanted = df.where("id % 10 = 0")
    got = thinned(df, F.col("h"), wanted, F.col("h"), 2000).select("id")
    assert got.where("id % 10 = 0").count() == 2000 and got.count() < 2000 + 18_000 / skew.BITS_PER_KEY * 2
    assert thinned(df, F.col("h"), wanted.limit(0), F.col("h"), 0).count() == 0
    marked = may_be_in(df, F.col("h"), wanted, F.col("h"), 2000)
    assert marked.count() == 20_001 and marked.where("id IS NULL AND NOT _may").count() == 1
    monkeypatch.setattr(skew, "MOST_BITS", 1 << 15)
    assert bitmap(wanted, F.col("h"), 1 << 40)[1] == 1 << 15
    assert thinned(df, F.col("h"), wanted, F.col("h"), 1 << 40).where("id % 10 = 0").count() == 2000
