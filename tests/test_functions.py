import os
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.functions import bloom, keys
from kvstrata.operators import blocks


def test_separators():
    assert keys.separator(b"abcdea", b"abcdez") == b"abcdeb"
    assert keys.separator(b"abc", b"abd") == b"abc"
    assert keys.separator(b"abcx", b"abd") == b"abcy"
    assert keys.separator(b"abc\xff\x01", b"abd") == b"abc\xff\x02"
    assert keys.separator(b"abc", b"abcd") == b"abc"
    assert keys.separator(b"b", b"a") == b"b"
    for a, b in ((b"1999", b"2"), (b"", b"x"), (b"aa", b"ac"), (b"a\xff", b"b\x01")):
        assert a <= keys.separator(a, b) < b
    assert keys.successor(b"\xffab") == b"\xffb" and keys.successor(b"\xff\xff") == b"\xff\xff" and keys.successor(b"") == b""
    assert keys.following(b"a") == b"b" and keys.following(b"\xff") == b"\xff\x00" and keys.following(b"") == b"\x00"


def test_byte_udfs_and_nulls(spark):
    df = spark.createDataFrame([("abcx", "abd"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    got = df.select(keys.shortest_separator_hex("a", "b").alias("s"), keys.short_successor_hex("a").alias("u"), keys.next_key_hex("a").alias("n"), keys.key_hash_udf(keys.BLOOM_SEED)("a").isNull().alias("h"), keys.shared_prefix("a", "b").alias("p"))
    assert rows(got) == sorted([("61626379", "62", "61626379", False, 2), (None, None, None, True, 0), (None, "62", "62", False, 0), ("", "", "00", False, 0)], key=repr)


def slow_hash(data, seed):
    h, n = (seed ^ len(data) * keys.HASH_MULTIPLIER) % 2**32, len(data) - len(data) % 4
    for i in range(0, n, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * keys.HASH_MULTIPLIER % 2**32
        h ^= h >> 16
    if rest := data[n:]:
        h = (h + int.from_bytes(rest, "little")) * keys.HASH_MULTIPLIER % 2**32
        h ^= h >> 24
    return h


def test_hash_is_vectorised_right():
    data = [b"", b"a", b"ab", b"abc", b"abcd", "é\x00\xff".encode(), b"x" * 101] * 2
    assert keys.hash32(data, keys.KEY_SEED).tolist() == [slow_hash(x, keys.KEY_SEED) for x in data]


def test_bloom_members_and_strangers():
    members = [b"abcdeeeeee", b"abcdefffff", b"abcdeggggg", b"abcdehhhhh", b"abcdeiiiii", b"abcdejjjjj"]
    filter_ = bloom.build(keys.hash32(members, keys.BLOOM_SEED))
    assert filter_[1] == 7 and len(filter_[2]) == 64 * filter_[0]
    assert bloom.may_match(keys.hash32(members, keys.BLOOM_SEED), *filter_).all()
    assert not bloom.may_match(keys.hash32([b"abcdejjjjjk", b"abcdejjjj", b"abcdejjjjjj"], keys.BLOOM_SEED), *filter_).any()
    many = np.arange(10_000) * 7919 % 2**32
    big = bloom.build(many)
    assert bloom.may_match(many, *big).all() and bloom.may_match(np.arange(10_000) * 104_729 + 3, *big).mean() < 0.05
    assert not bloom.may_match(many, *bloom.build(np.empty(0, np.int64))).any()


def test_bloom_frames(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, None), (3, [])], "id long, h array<long>")
    built = bloom.build_filters(df, "id", "h")
    assert rows(built, "id", "n_hashes", "lines") == [(1, 2, 1), (2, 0, 0), (3, 0, 0)]
    assert rows(bloom.probe_filters(df.join(built, "id"), "id", "h")) == [(1, 2, 0), (2, 0, 0), (3, 0, 0)]


def test_internal_keys_and_numbers(spark):
    top = keys.MAX_SEQUENCE
    df = spark.createDataFrame([("k", 1, 1), ("é", top, 0), ("", 200, 5), (None, 1, 1)], "k string, s long, t int")
    x = df.withColumn("x", keys.internal_key_hex("k", "s", "t"))
    assert rows(x.where("k = 'k'"), "x") == [("6B0101000000000000",)]
    back = x.select("k", "s", "t", keys.user_key_of("x").alias("k2"), keys.sequence_of("x").alias("s2"), keys.value_type_of("x").alias("t2")).where("k IS NOT NULL AND s < 72057594037927935")
    assert all(r.k == r.k2 and r.s == r.s2 and r.t == r.t2 for r in back.collect())
    n = spark.createDataFrame([(0,), (127,), (128,), (16_383,), (16_384,), (2**62,), (None,)], "n long")
    assert [r[0] for r in n.select(keys.varint_length("n")).collect()] == [1, 1, 2, 2, 3, 9, None]
    c = spark.createDataFrame([(0,), (1,), (0xFFFFFFFF,), (0xDEADBEEF,)], "c long").withColumn("m", keys.crc_mask("c"))
    assert rows(c.where("c = 0"), "m") == [(keys.MASK_DELTA,)]
    assert all(r.c == r.u for r in c.withColumn("u", keys.crc_unmask("m")).collect())
    names = spark.createDataFrame([("MANIFEST-000123",), ("000456.log",), ("CURRENT",), ("1234567.sst",), ("x.log",), (None,)], "n string")
    assert [tuple(r) for r in names.select(keys.parse_file_type("n"), keys.parse_file_number("n")).collect()] == [("manifest", 123), ("log", 456), ("current", 0), ("table", 1234567), (None, None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(7,), (1234567,)], "n long").select(keys.file_name("n", "log")).collect()] == ["000007.log", "1234567.log"]
    p = spark.createDataFrame([(5, 0), (5, 1), (5, 3)], "n long, p long").withColumn("x", keys.pack_file_number("n", "p"))
    assert [r[0] for r in p.select(keys.path_id("x")).collect()] == [0, 1, 3]


def test_varints(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**32 - 1, 2**56, 2**63 - 1, -1, None]

    def plain(n):
        n, out = n & (1 << 64) - 1, []
        while n > 127:
            out, n = [*out, n & 127 | 128], n >> 7
        return bytes([*out, n]).hex().upper()

    df = spark.createDataFrame([(n,) for n in numbers], "n long").withColumn("x", keys.varint_hex("n"))
    assert [r.x for r in df.collect()] == [None if n is None else plain(n) for n in numbers]
    assert [r.v for r in df.select(keys.varint_value(F.concat("x", F.lit("8001"))).alias("v")).collect()] == numbers
    assert spark.createDataFrame([("80",), ("",), ("FFFF",)], "x string").select(keys.varint_value("x").alias("v")).where("v IS NOT NULL").count() == 0


def test_blocks_match_one_entry_at_a_time(spark):
    r = random.Random(4)
    made = [(f, "".join(r.choices("ab", k=r.choice([1, 3, 8, 300]))), "v" * r.choice([0, 5, 700, 20_000]) if r.random() < 0.9 else None, i) for i in range(900) for f in [r.choice([1, 1, 2])]]
    size = lambda n: max(1, -(-n.bit_length() // 7))
    want, last = [], None
    for f, k, v, i in sorted(made, key=lambda x: (x[0], x[1].encode(), -x[3])):
        n = len(v or "")
        if last is None or last[0] != f or last[5] >= 4096:
            last = [f, last[1] + 1 if last and last[0] == f else 0, k, None, 0, 8]
            want.append(last)
        shared = len(os.path.commonprefix([k, last[3]])) if last[4] % 16 else 0
        last[5] += size(shared) + size(len(k) + 8 - shared) + size(n) + len(k) + 8 - shared + n + (4 if last[4] and last[4] % 16 == 0 else 0)
        last[3], last[4] = k, last[4] + 1
    df = spark.createDataFrame(made, "file_id long, key string, value string, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert sorted(tuple(x) for x in blocks.cut_blocks(df, "file_id").collect()) == sorted(map(tuple, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks(spark):
    kv = spark.createDataFrame([(f, f"key{i:05}", "v" * 50, i) for f in (1, 2) for i in range(500)] + [(3, "only", None, 1)], "file_id long, key string, value string, seq long")
    cut = blocks.cut_blocks(kv, "file_id").cache()
    by = {}
    for r in cut.orderBy("file_id", "block_no").collect():
        by.setdefault(r.file_id, []).append(r)
    assert [sum(b.n_entries for b in by[f]) for f in (1, 2, 3)] == [500, 500, 1]
    assert all(b.n_bytes >= blocks.BLOCK_SIZE for f in (1, 2) for b in by[f][:-1])
    assert all(a.last_key < b.first_key and a.block_no + 1 == b.block_no for f in (1, 2) for a, b in zip(by[f], by[f][1:]))
    entries = {(r.file_id, r.block_no): bytes.fromhex(r.separator_hex) for r in blocks.index_entries(cut).collect()}
    for f in (1, 2):
        for a, b in zip(by[f], by[f][1:]):
            assert a.last_key.encode() <= entries[f, a.block_no] < b.first_key.encode()
    assert entries[3, 0] == b"p"
    assert blocks.cut_blocks(kv.limit(0), "file_id").count() == 0
    stats = blocks.delta_stats(spark.createDataFrame([(0, k) for k in ("abc", "abd", "b")], "f int, key string"), ["f"])
    assert rows(stats) == [(0, 3, 2, 5)]


def test_collectors(spark):
    from kvstrata.operators.compact import file_stats

    kv = spark.createDataFrame([(1, "a", 1, "PUT", "xx"), (1, "b", 2, "DEL", None)], "f int, key string, seq long, op string, value string")
    assert rows(file_stats(kv, ["f"], [F.countDistinct("key").alias("n_keys")])) == [(1, "a", "b", 1, 2, 2, 1, 2, 2, 2)]
