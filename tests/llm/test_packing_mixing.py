import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.llm import mixing, packing
from kvstrata.llm.mixing import blocks_of, checked_shares, draw, permuted, shares
from kvstrata.llm.packing import checked_assignment, fill_report, pack, pack_shard, read_specs, sized_documents
from kvstrata.llm.tokens import encoder, token_count, with_tokens

ITEMS = "doc_id long, source string, cluster long, tokens long"
SIZED = "doc_id long, source string, tokens long"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_tokens(spark):
    enc = encoder()
    assert token_count(None, enc) == token_count("", enc) == 0
    long = "word " * 30_000 + "x" * 131_077 + " " * 65_536 + "end"
    assert token_count("Hello world", enc) == 2 and token_count(long, enc) == len(enc.encode_ordinary(long)) > 30_000
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, text string")
    assert rows(with_tokens(df, "text", ["id"])) == [(1, 2), (2, 0), (3, 0), (4, token_count("<|endoftext|>", enc))]


def made(n=3000, seed=1):
    r = random.Random(seed)
    items = [(i, r.choice(["a", "a", "b", None]), i, r.choice([0, r.randrange(1, 60), r.randrange(1, 700), 2500])) for i in range(n)]
    return items + [(n + i, "a", -1, 7) for i in range(n // 2)]  # a third are copies of one short text


def test_shard_packing_is_whole_and_tight():
    items = [(i, n, source, cluster) for i, source, cluster, n in made()]
    for capacity, sources in ((512, None), (512, 1), (2048, 2)):
        out = pack_shard(items, capacity, sources)
        got = Counter()
        for i, _, size, _ in out:
            got[i] += size
        assert got == Counter({i: x[1] for i, x in enumerate(items)}) and set(got) == set(range(len(items)))
        held = Counter()
        inside = {}
        for i, piece, size, b in out:
            held[b] += size
            inside.setdefault(b, []).append(i)
        assert max(held.values()) <= capacity
        whole = {i for i, n in Counter(x[0] for x in out).items() if n > 1}
        assert all(items[i][1] > capacity for i in whole)
        if sources:
            assert all(len({items[i][2] for i in b}) <= sources for b in inside.values())
        assert sum(held.values()) / (len(held) * capacity) > 0.97
        assert max(sum(items[i][3] == -1 for i in b) for b in inside.values()) <= 5  # 1500 copies in no more containers than are needed


def test_copies_are_spread():
    items = [(i, 50, "a", i % 10) for i in range(200)]
    inside = {}
    for i, _, _, b in pack_shard(items, 500, None):
        inside.setdefault(b, []).append(items[i][3])
    assert all(len(set(c)) == len(c) for c in inside.values()) and len(inside) == 20


def test_pack_frames(spark):
    items = made(2000)
    df = spark.createDataFrame(items + [(None, None, None, 5), (3, "a", 3, 9)], ITEMS).withColumn("shard", F.lit("clash"))
    specs = {"small": 512, "big": 8192}
    out = pack(df.drop("shard"), specs, shard_items=500).cache()
    total = sum(x[3] for x in items) + 14
    for r in fill_report(out, specs).collect():
        assert r.tokens == total and r.fullest <= r.capacity_tokens and r.fill > 0.9
    pieces = out.where("spec_name = 'big'")
    assert pieces.count() == len(items) + 2 and pieces.where("doc_id IS NULL").count() == 1
    empty = pack(df.drop("shard").limit(0), specs)
    assert empty.count() == 0 and fill_report(empty, specs).count() == 0 and fill_report(empty, {}).count() == 0


def test_the_same_rows_are_packed_alike_however_they_lie(spark):
    r = random.Random(6)
    items = [(r.choice([None, i]), r.choice(["a", "b", None]), r.choice([None, i % 50]), r.choice([0, r.randrange(1, 300)])) for i in range(1500)]
    items += [(5, "a", 1, 9)] * 700  # wholly equal rows
    frames = [spark.createDataFrame(items, ITEMS), spark.createDataFrame(r.sample(items, len(items)), ITEMS).repartition(7)]
    a, b = (rows(pack(f, {"s": 512}, shard_items=200)) for f in frames)
    assert a == b and len({x[1] >> 32 for x in a}) == 11 and len(a) == 2200
    assert len({x[1] >> 32 for x in a if x[2] == 5}) > 5  # they are not one shard


def test_checked_assignment(spark):
    items = spark.createDataFrame([(1, "a", 1, 10), (2, "a", 2, 1500), (3, None, 3, 0)], ITEMS)
    good = pack(items, {"s": 512})
    assert rows(checked_assignment(items, good, {"s": 512})) == [("s", 512, 3, 3, 0)]
    torn = good.withColumn("tokens", F.when(F.col("doc_id") == 1, 600).otherwise(F.col("tokens")).cast("long"))
    assert rows(checked_assignment(items, torn, {"s": 512})) == [("s", 512, 3, 2, 1)]


def test_specs_and_documents(spark):
    specs = spark.createDataFrame([("a", 10), (None, 5), ("b", None), ("c", 0)], "spec_name string, capacity_tokens int")
    assert read_specs(specs) == {"a": 10}
    docs = spark.createDataFrame([(1, "Hello world", "s"), (2, "Hello world", None), (3, None, "s")], "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("tokens", "cluster", "_text")})
    got = rows(sized_documents(docs), "doc_id", "source", "tokens")
    assert got == [(1, "s", 2), (2, None, 2), (3, "s", 0)]


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        for key in (0, 5, 1 << 60):
            images = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(images) == list(range(n))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a == b).mean() < 0.05 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def sized(spark, counts, seed=3):
    r = random.Random(seed)
    data, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            data.append((i, source, r.choice([3, r.randrange(1, 400), r.randrange(1, 400), 3000])))
            i += 1
    return spark.createDataFrame([*data, (i, None, 50), (i + 1, "a", 0), (None, "a", 5)], SIZED)


def test_blocks_hold_whole_records(spark, monkeypatch):
    df = sized(spark, {"a": 900, "b": 40})
    got = blocks_of(df, 1024, shard_items=200).cache()
    assert got.count() == 940 == got.select("doc_id").distinct().count()
    for r in got.groupBy("source").agg(F.max("block").alias("top"), F.countDistinct("block").alias("n")).collect():
        assert r.top + 1 == r.n
    assert got.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).where("t > 1024 AND n > 1").count() == 0


@pytest.mark.parametrize("per_shard", [16, 256])
def test_shares_and_caps(spark, per_shard, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", per_shard)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    df = sized(spark, {"a": 1500, "b": 500, "c": 120}).cache()
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 3), ("m", "c", 0.15, 4), ("m", "missing", 0.05, 2), ("one", "c", 1.0, None), ("none", "missing", 1.0, 1), (None, "a", 1.0, 1), ("m", None, 0.1, 1), ("m", "a2", None, 1)], TARGETS)
    out = draw(df, targets).cache()
    assert rows(out, "mix_name", "slot", "source", "block", "doc_id") == rows(draw(df, targets), "mix_name", "slot", "source", "block", "doc_id")
    got = {(r.mix_name, r.source): r for r in shares(out, targets.where("mix_name IS NOT NULL AND source IS NOT NULL"), df).collect()}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got["m", source].actual_share - share / 0.95) < 0.01
        assert got["m", source].most_uses <= got["m", source].max_repeats
    assert got["m", "missing"].tokens == 0 and got["none", "missing"].actual_share == 0
    assert got["one", "c"].most_uses == 1 and got["one", "c"].actual_share == 1.0
    assert out.where("copy_no > 4").count() == 0


def test_a_tiny_source_is_capped_not_binding(spark):
    df = spark.createDataFrame([(i, "a", 100) for i in range(500)] + [(9999, "b", 5)], SIZED)
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 3)], TARGETS)
    got = {r.source: r for r in shares(draw(df, targets), targets, df).collect()}
    assert got["b"].most_uses == 3 and got["b"].tokens == 15 and got["a"].tokens > 5000


def test_slots_spread_over_the_tasks(spark, monkeypatch):
    """Slots of two mixes, one with a source of nearly all slots, in at least as many tasks as shuffles have, of about equal size."""
    plan = [("m", 0, "a", 0, 90_000, 1000, 5), ("m", 0, "b", 0, 10, 7, 6), ("n", 0, "a", 0, 500, 1000, 7)]
    df = mixing._slots(spark.createDataFrame(plan, "mix_name string, shard long, source string, begin long, n long, blocks long, key long"), 90_510)
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 90_510 and len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 90_510 / len(sizes)
    assert df.groupBy("mix_name", "source", "slot").count().where("count > 1").count() == 0
    monkeypatch.setattr(mixing, "SLOTS_PER_TASK", 1000)
    assert mixing.slot_tasks(spark, 90_510) == 91


def test_shares_are_checked(spark):
    df = spark.createDataFrame([(i, "a", 100) for i in range(500)] + [(1000 + i, "b", 100) for i in range(300)], SIZED)
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.4, 3), ("m", "none", 0.1, 1)], TARGETS)
    drawn = draw(df, targets).cache()
    assert rows(checked_shares(shares(drawn, targets, df))) == [("m", "a", 1, True, True, True), ("m", "b", 3, True, True, True), ("m", "none", 1, False, True, True)]
    bad = drawn.where("source = 'a'").limit(50).unionByName(drawn.where("source = 'b'").unionByName(drawn.where("source = 'b'")).unionByName(drawn.where("source = 'b'")).unionByName(drawn.where("source = 'b'")))
    wrong = {r.source: r for r in checked_shares(shares(bad, targets, df)).collect()}
    assert not wrong["a"].near_target and not wrong["b"].within_repeats


def test_empty(spark):
    none, targets = spark.createDataFrame([], SIZED), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert draw(none, targets).count() == 0 == draw(none, targets.limit(0)).count()
    assert rows(shares(draw(none, targets), targets, none), "source", "tokens", "docs") == [("a", 0, 0)]
    assert packing.SHARD_ITEMS > 0
