import random

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.operators import seen
from kvstrata.operators.seen import QuotientFilter, decide, seen_before, wrong_answers

HISTORY, INCOMING = "db int, k string", "no long, db int, k string"


def test_filters_keep_and_merge_fingerprints():
    r = np.random.default_rng(1)
    for n, q, bits in ((0, 6, 5), (1, 6, 12), (50, 6, 3), (5000, 12, 7), (1 << 9, 6, 3)):
        a, b = (np.unique(r.integers(0, 1 << q + bits, n)) for _ in range(2))
        x, y = (QuotientFilter.build(z, q, bits) for z in (a, b))
        assert (x.prints() == a).all() and len(x.remainders) == -(-len(a) * bits // 8)
        assert (x.merged(y).prints() == np.union1d(a, b)).all()
        small = QuotientFilter.fitted(a, q + bits)
        assert (small.prints() == a).all() and (small.merged(y).prints() == np.union1d(a, b)).all()
        assert sum(map(len, (small.occupied, small.run_ends, small.remainders))) * 8 <= len(a) * (q + bits + 4) + 40


def brute(history, incoming):
    known, out = set(history), set()
    for no, *key in sorted({x for x in incoming if x[2] is not None}):
        if tuple(key) in known:
            out.add(no)
        known.add(tuple(key))
    return out


def test_sequential_decisions(spark, monkeypatch):
    r = random.Random(3)
    for shard_keys, r_bits in ((1 << 17, 12), (64, 2), (64, 12)):
        monkeypatch.setattr(seen, "SHARD_KEYS", shard_keys)
        monkeypatch.setattr(seen, "TASK_KEYS", 200 if shard_keys == 64 else 1 << 21)
        key = lambda: (r.choice([1, 1, 2]), r.choice(["hot"] * 300 + [f"k{i}" for i in range(1500)]))
        history = [key() for _ in range(1500)] + [(1, None)]
        incoming = [(i, *key()) for i in range(600)] + [(1000, 1, None)]
        got = seen_before(spark.createDataFrame(history, HISTORY).repartition(3), spark.createDataFrame(incoming + incoming[::4], INCOMING), ["k"], ["db"], "no", r_bits).cache()
        want = brute(history, incoming)
        assert {x.no for x in got.where("seen").collect()} == want
        assert want <= {x.no for x in got.where("perhaps").collect()}
        report = wrong_answers(got).first()
        assert report.n_incoming == 600 and report.n_seen == len(want) and report.n_wrong == report.n_perhaps - report.n_seen
        if r_bits == 2:
            assert report.n_wrong > 0 and 0.3 < report.measured_rate / report.derived_rate < 3


def test_null_scope_empty_and_clashes(spark):
    history = spark.createDataFrame([(None, "a"), (1, "é"), (1, "")], HISTORY)
    incoming = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, 1, "é"), (4, 1, ""), (5, 2, "x" * 100_000), (6, 2, "x" * 100_000)], INCOMING)
    extra = {c: F.lit(1) for c in ("print", "perhaps", "old", "first_no", "shard", "seen")}
    got = seen_before(history.withColumns(extra), incoming.withColumns(extra), ["k"], ["db"], "no")
    assert rows(got.where("seen"), "no") == [(1,), (3,), (4,), (6,)]
    assert seen_before(history.limit(0), incoming.limit(0), ["k"], ["db"], "no").count() == 0
    assert rows(decide(history.limit(0), incoming, ["k"], ["db"], "no")[0].where("perhaps"), "no") == [(6,)]
    assert wrong_answers(seen_before(history, incoming.limit(0), ["k"], ["db"], "no")).first().measured_rate == 0
