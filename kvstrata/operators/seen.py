"""Has a key been seen before?

Method: quotient filters.  A key's fingerprint of q + r bits is split into a
quotient and a remainder.  Each task that reads history turns its keys into
sorted filters, one for each range of quotients (shard): remainders packed to r
bits, an occupancy bit per quotient and a bit where a run of equal quotients
ends.  These filters are shuffled, a few bytes a key; filters of a shard are
merged in order of fingerprint, and the incoming keys' fingerprints are streamed
over the merged filter.  An incoming key is "perhaps seen" if its fingerprint is
in the filter or an earlier incoming key has it.  A filter never misses a key, so
only the "perhaps" are checked exactly: history rows are thinned by a bitmap of
the fingerprints that the filter holds, and only what is left is shuffled to meet
the keys asked for.  The report gives the share of wrong "perhaps" as measured
and as derived (keys / 2^(q + r)).

Memory: a shard holds about ``SHARD_KEYS`` keys however many there are.  A hot
history key is one fingerprint per task; incoming rows are folded to one row a
key (first arrival and number), which meets filter and history, and go back to
the rows in a join that keeps hot keys apart.

Defined results: incoming rows with a null key are undecided and not reported as
seen; history rows with a null key are ignored; null scope columns compare as
equal; repeated rows of one incoming key (same number) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.operators.changes import null_safe_join
from kvstrata.operators.skew import spread_join, thinned
from kvstrata.sources.scratch import durable

REMAINDER_BITS = 12
LOAD = 0.75
SHARD_KEYS = 1 << 17
#: Fingerprints a task holds before it turns them into filters.
TASK_KEYS = 1 << 21


class QuotientFilter:
    """Sorted fingerprints of one shard in packed form."""

    __slots__ = ("n", "q_bits", "r_bits", "occupied", "run_ends", "remainders")

    def __init__(self, n: int, q_bits: int, r_bits: int, occupied: bytes, run_ends: bytes, remainders: bytes):
        self.n, self.q_bits, self.r_bits, self.occupied, self.run_ends, self.remainders = n, q_bits, r_bits, occupied, run_ends, remainders

    @classmethod
    def build(cls, prints: np.ndarray, q_bits: int, r_bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints below 2^(q_bits + r_bits)."""
        quotient = prints >> r_bits
        taken = np.zeros(1 << q_bits, bool)
        taken[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)[: len(prints)]
        bits = (prints[:, None] >> np.arange(r_bits)) & 1
        return cls(len(prints), q_bits, r_bits, np.packbits(taken).tobytes(), np.packbits(ends).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes())

    def prints(self) -> np.ndarray:
        """The sorted fingerprints again."""
        if not self.n:
            return np.empty(0, np.int64)
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8)))
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=self.n))
        bits = np.unpackbits(np.frombuffer(self.remainders, np.uint8), count=self.n * self.r_bits).reshape(self.n, self.r_bits)
        rest = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.r_bits, dtype=np.int64))
        return (np.repeat(occupied, np.diff(ends, prepend=-1)) << self.r_bits) | rest

    @classmethod
    def fitted(cls, prints: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints of so many bits, with as many quotients as suit their number.

        Bits move between quotient and remainder and the fingerprints stay the same,
        so filters of any sizes merge, and a small one does not pay for a large one's
        occupancy bits."""
        q_bits = min(bits - 1, max(3, int(np.ceil(np.log2(max(1, len(prints)) / LOAD)))))
        return cls.build(prints, q_bits, bits - q_bits)

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        """One filter that holds the keys of both."""
        return QuotientFilter.fitted(np.union1d(self.prints(), other.prints()), self.q_bits + self.r_bits)


def filter_shape(keys: int, r_bits: int = REMAINDER_BITS) -> tuple[int, int, int]:
    """(q_bits, r_bits, shard bits) for an expected number of keys."""
    q_bits = max(6, int(np.ceil(np.log2(max(1, keys) / LOAD))))
    return q_bits, r_bits, max(0, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


def fingerprint(columns: list[str], bits: int):
    """The top ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)


_FILTER = "shard long, kind int, n long, q_bits int, occupied binary, run_ends binary, remainders binary, print long"


def build_filters(prints: DataFrame, q_bits: int, r_bits: int, s_bits: int) -> DataFrame:
    """Filters of each task's keys, per shard, from a column of fingerprints."""
    local = q_bits - s_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.unique(np.concatenate(parts))
            shards = keys >> (local + r_bits)
            cuts = np.flatnonzero(np.diff(shards, prepend=-1))
            made = [(int(shards[c]), QuotientFilter.fitted(x & ((1 << local + r_bits) - 1), local + r_bits)) for c, x in zip(cuts, np.split(keys, cuts[1:]))]
            none = pa.nulls(len(made), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in made], pa.int64()), pa.array(np.zeros(len(made), np.int32)), pa.array([f.n for _, f in made], pa.int64()), pa.array([f.q_bits for _, f in made], pa.int32()), *[pa.array([getattr(f, c) for _, f in made], pa.binary()) for c in ("occupied", "run_ends", "remainders")], none],
                names=["shard", "kind", "n", "q_bits", "occupied", "run_ends", "remainders", "print"],
            )

        held, size = [], 0
        for b in batches:
            held.append(np.unique(b.column(0).to_numpy(zero_copy_only=False)))
            size += len(held[-1])
            if size > TASK_KEYS:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > TASK_KEYS // 2:
                    yield filters(held)
                    held, size = [], 0
        if size:
            yield filters(held)

    return prints.mapInArrow(run, _FILTER)


def probe_filters(filters: DataFrame, prints: DataFrame, q_bits: int, r_bits: int, s_bits: int) -> DataFrame:
    """(print, in_filter) for distinct fingerprints: the filters of each shard are merged and the fingerprints streamed over them."""
    local = q_bits - s_bits
    asked = prints.select(F.shiftright("print", local + r_bits).alias("shard"), F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("n", "long"), ("q_bits", "int"), ("occupied", "binary"), ("run_ends", "binary"), ("remainders", "binary"))], "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, merged = None, [], np.empty(0, np.int64)
        for b in batches:
            shards, kinds, asks = (pc.fill_null(b.column(i), 0).to_numpy(zero_copy_only=False) for i in (0, 1, 7))
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1), len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    shard, waiting, merged = shards[lo], [], np.empty(0, np.int64)
                if kinds[lo] == 0:
                    for n, q, *blobs in zip(*(b.column(i).slice(lo, hi - lo).to_pylist() for i in (2, 3, 4, 5, 6))):
                        waiting.append(QuotientFilter(n, q, local + r_bits - q, *blobs).prints())
                        if sum(map(len, waiting)) > 4 * SHARD_KEYS:
                            waiting = [np.unique(np.concatenate(waiting))]
                    continue
                if waiting:
                    whole = QuotientFilter.fitted(np.unique(np.concatenate(waiting)), local + r_bits)  # the merged filter
                    waiting, merged = [], whole.prints()
                ask = asks[lo:hi].astype(np.int64)
                key = ask & ((1 << local + r_bits) - 1)
                at = np.minimum(np.searchsorted(merged, key), max(0, len(merged) - 1))
                hit = merged[at] == key if len(merged) else np.zeros(len(key), bool)
                yield pa.RecordBatch.from_arrays([pa.array(ask), pa.array(hit)], names=["print", "in_filter"])

    both = filters.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, "print long, in_filter boolean")


def _asked(history: DataFrame, incoming: DataFrame, key: list[str], scope: list[str], no: str, r_bits: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(history of keys, incoming rows with their fingerprint, facts per incoming key, bits of a fingerprint, history keys)."""
    columns = [*scope, *key]
    for k in key:
        history, incoming = history.where(F.col(k).isNotNull()), incoming.where(F.col(k).isNotNull())
    history, incoming = history.select(*columns), incoming.select(no, *columns).distinct()
    keys = history.agg(F.approx_count_distinct(F.xxhash64(*columns), 0.02)).first()[0]
    q_bits, r_bits, s_bits = filter_shape(int(keys * 1.05) + 1, r_bits)
    bits = q_bits + r_bits
    filters = build_filters(history.select(fingerprint(columns, bits).alias("print")), q_bits, r_bits, s_bits)
    asked = durable(incoming)
    facts = durable(asked.groupBy(*columns).agg(F.min(no).alias("first_no"), F.count("*").alias("load")).withColumn("print", fingerprint(columns, bits)))
    prints = facts.groupBy("print").agg(F.min("first_no").alias("print_no"))
    known = prints.join(probe_filters(filters, prints.select("print"), q_bits, r_bits, s_bits).hint("merge"), "print")
    return history, asked, durable(facts.join(known.hint("merge"), "print")), bits, keys


def decide(history: DataFrame, incoming: DataFrame, key: list[str], scope: list[str], no: str, r_bits: int = REMAINDER_BITS) -> tuple[DataFrame, int]:
    """(no, scope, key, perhaps) for every distinct incoming row with a key, and the number of history keys; columns of ``history``: scope, key."""
    _, asked, facts, _, keys = _asked(history, incoming, key, scope, no, r_bits)
    rows = spread_join(asked, facts.select(*scope, *key, "in_filter", "print_no", "load"), [*scope, *key], "load", asked.count(), null_safe=True)
    return rows.select(no, *scope, *key, (F.col("in_filter") | (F.col("print_no") < F.col(no))).alias("perhaps")), keys


def seen_before(history: DataFrame, incoming: DataFrame, key: list[str], scope: list[str], no: str, r_bits: int = REMAINDER_BITS) -> DataFrame:
    """(no, scope, key, perhaps, seen, derived_rate): the filter's answer and the exact one, for which only the "perhaps" are looked up."""
    history, asked, facts, bits, keys = _asked(history, incoming, key, scope, no, r_bits)
    columns = [*scope, *key]
    held = facts.where("in_filter")
    earlier = thinned(history, fingerprint(columns, bits), held, F.col("print"), held.count()).distinct()
    old = null_safe_join(held, earlier.hint("merge"), columns, "left_semi").select(*columns, F.lit(True).alias("old"))
    facts = durable(null_safe_join(facts, old.hint("merge"), columns, "left").select(*columns, "in_filter", "print_no", "first_no", F.coalesce("old", F.lit(False)).alias("old"), "load"))
    rows = spread_join(asked, facts, columns, "load", asked.count(), null_safe=True)
    perhaps = F.col("in_filter") | (F.col("print_no") < F.col(no))
    seen = perhaps & (F.col("old") | (F.col("first_no") < F.col(no)))
    return rows.select(no, *columns, perhaps.alias("perhaps"), seen.alias("seen"), F.lit(float(keys) / 2.0**bits).alias("derived_rate"))


def wrong_answers(decided: DataFrame) -> DataFrame:
    """One row: incoming keys, "perhaps", seen, wrong "perhaps", the share of unseen keys answered wrongly, and the derived share."""
    out = decided.agg(F.count("*").alias("n_incoming"), F.count_if("perhaps").alias("n_perhaps"), F.count_if("seen").alias("n_seen"), F.count_if(F.col("perhaps") & ~F.col("seen")).alias("n_wrong"), F.max("derived_rate").alias("derived_rate"))
    unseen = F.col("n_incoming") - F.col("n_seen")
    return out.select("n_incoming", "n_perhaps", "n_seen", "n_wrong", F.when(unseen > 0, F.col("n_wrong") / unseen).otherwise(F.lit(0.0)).alias("measured_rate"), "derived_rate")
