"""Records from several sources in target shares of the total size.

Method: the tokens of each source are packed into blocks of fixed length (whole
records, best fit; a longer record is a block of its own), numbered 0..n-1 within
the source.  Each output shard draws how many of its slots go to each source
from a multinomial over what is left of the sources' quotas, so that the totals
come out at the quotas.  The j-th slot of a source takes, in round j div n, the
block at place j mod n of a pseudorandom permutation of 0..n-1 (a Feistel network
with cycle walking, another for each round), and blocks are joined by index.  So
no block, and no record, is used more than ceil(slots / n) <= max_repeats times.

Size of the mix: the largest at which no source needs more than max_repeats of
its tokens, over the sources that exist, whose target shares are scaled to sum
to 1.  If a source is so small that this falls below ``least_fraction`` of the
mix's tokens, that fraction is taken; such a source is then used max_repeats
times and falls short, which the reported shares show.

Skew: a hot source is packed in shards by a hash of the record id, and the block
index spreads the final join evenly.  The driver only sees per-source totals of
the named sources and the shard plan, which is bounded by ``MAX_SHARDS``.

Defined results: records without tokens (null or empty text), without an id or
without a source are never drawn; targets that are null or not above 0, or whose source
has no tokens, get no slots; a null max_repeats counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvstrata.llm.packing import SHARD_ITEMS, pack_shard
from kvstrata.sources.scratch import durable

BLOCK_TOKENS = 1024
SLOTS_PER_SHARD = 256
#: Slots that one task makes at most, and the pieces of the plan that a task is dealt.
SLOTS_PER_TASK, PIECES_PER_TASK = 1 << 18, 4
MAX_SHARDS = 4096
LEAST_FRACTION = 0.25
#: Sums per (mix, source) that the driver sees at a time.
BUCKETS = 1024
#: Rows that mix_targets may have; it is a parameter list.
MOST_TARGETS = 10_000


def blocks_of(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(source, block, doc_id, tokens): records (doc_id, source, tokens) in blocks numbered 0..n-1 in each source."""
    use = sized.where("source IS NOT NULL AND doc_id IS NOT NULL AND tokens > 0").select("source", "doc_id", "tokens")
    loads = use.groupBy("source").agg(F.ceil(F.count("*") / shard_items).alias("shards"))
    spread = use.join(loads, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.col("shards")))

    def run(pdf):
        import pandas as pd

        rows = [(int(i), int(n), None, None) for i, n in zip(pdf["doc_id"], pdf["tokens"])]
        out = pack_shard(rows, block_tokens, None, cut=False)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "shard": int(pdf["shard"].iloc[0]), "local": [x[3] for x in out], "doc_id": [rows[x[0]][0] for x in out], "tokens": [x[2] for x in out]})

    packed = durable(spread.groupBy("source", "shard").applyInPandas(run, "source string, shard long, local long, doc_id long, tokens long"))
    w = Window.partitionBy("source").orderBy("shard")
    offsets = packed.groupBy("source", "shard").agg((F.max("local") + 1).alias("n")).withColumn("offset", F.sum("n").over(w) - F.col("n")).drop("n")
    return packed.join(offsets, ["source", "shard"]).select("source", (F.col("offset") + F.col("local")).alias("block"), "doc_id", "tokens")


def _quotas(targets: list[tuple], stats: dict, least_fraction: float) -> dict[str, tuple[int, float, int]]:
    """Per source of one mix: slots by the mean block, wanted tokens, and the most slots."""
    live = [(s, share, max(1, cap), *stats[s]) for s, share, cap in targets if s in stats]
    if not live:
        return {}
    whole = sum(x[1] for x in live)
    size = max(min(cap * tokens * whole / share for _, share, cap, tokens, _ in live), least_fraction * sum(x[3] for x in live))
    out = {}
    for s, share, cap, tokens, blocks in live:
        want = min(share / whole * size, cap * tokens)
        out[s] = (min(cap * blocks, max(1, int(want / (tokens / blocks) + 0.5))), want, cap * blocks)
    return out


def _split_slots(slots: dict[str, int], seed: int) -> list[tuple]:
    """Rows (shard, source, first slot of the source, slots): multinomial draws over what is left of each source's slots."""
    names = sorted(slots)
    left = np.array([slots[s] for s in names], np.int64)
    per_shard = max(SLOTS_PER_SHARD, int(-(-left.sum() // MAX_SHARDS)))
    rng, begun, out, shard = np.random.default_rng(seed), np.zeros(len(names), np.int64), [], 0
    while (rest := int(left.sum())) > 0:
        want = min(per_shard, rest)
        drawn = np.minimum(rng.multinomial(want, left / rest), left)
        while (lack := want - int(drawn.sum())) > 0:
            free = left - drawn
            drawn += np.minimum(rng.multinomial(lack, free / free.sum()), free)
        out += [(shard, names[i], int(begun[i]), int(n)) for i, n in enumerate(drawn) if n]
        begun += drawn
        left -= drawn
        shard += 1
    return out


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of places 0 <= place < n under a pseudorandom permutation of 0..n-1 that depends on the key."""
    u = np.uint64
    n = n.astype(u)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) if x > 1 else 1 for x in np.unique(n)], u)[np.searchsorted(np.unique(n), n)]
    mask = (u(1) << half) - u(1)

    def once(x: np.ndarray, m: np.ndarray, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k + u(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) * u(0xBF58476D1CE4E5B9)
            f ^= f >> u(31)
            f *= u(0x94D049BB133111EB)
            f ^= f >> u(29)
            left, right = right, left ^ (f & m)
        return (left << h) | right

    with np.errstate(over="ignore"):
        out = once(place.astype(u), mask, half, key.astype(np.int64).view(u))
        while (far := np.flatnonzero(out >= n)).size:
            out[far] = once(out[far], mask[far], half[far], key[far].astype(np.int64).view(u))
    return out.astype(np.int64)


def slot_tasks(spark: SparkSession, slots: int) -> int:
    """Tasks that a number of slots is dealt to: at least as many as shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // SLOTS_PER_TASK))


def _slots(plan: DataFrame, slots: int) -> DataFrame:
    """(mix_name, shard, slot, source, copy_no, block) of plan rows (mix_name, shard, source, begin, n, blocks, key), ``slots`` in all.

    The plan is cut into pieces, and these are dealt in turn to a fixed number of
    tasks, so no mix, source or shard is one task, and adaptive execution does not
    fold the tiny plan into one, either."""
    tasks = slot_tasks(plan.sparkSession, slots)
    step = max(1, -(-slots // (tasks * PIECES_PER_TASK)))
    parts = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("o")).repartition(tasks)
    each = parts.select("mix_name", "shard", "source", "blocks", "key", F.explode(F.sequence(F.col("begin") + F.col("o"), F.col("begin") + F.least(F.col("n"), F.col("o") + step) - 1)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n) for n in ("mix_name", "shard", "source", "j")}
            j, n, key = (b.column(x).to_numpy(zero_copy_only=False) for x in ("j", "blocks", "key"))
            turn = j // n
            with np.errstate(over="ignore"):
                block = permuted(j % n, n, key + turn * np.int64(0x5851F42D4C957F2D))
            yield pa.RecordBatch.from_arrays([c["mix_name"], c["shard"], c["j"], c["source"], pa.array(turn + 1), pa.array(block)], names=["mix_name", "shard", "slot", "source", "copy_no", "block"])

    return each.mapInArrow(run, "mix_name string, shard long, slot long, source string, copy_no long, block long")


def _cut(slots, sizes: DataFrame, quotas: dict) -> dict[tuple, int]:
    """Slots per (mix, source) whose blocks come nearest to the wanted tokens.

    Blocks differ in size, so the sums over at most BUCKETS runs of slots are
    taken, the run that the wanted size falls into is split again, and so on
    until a run is one slot or under a ten-thousandth of the wanted size."""
    span = {(m, s): (0, min(most, 2 * n + 64)) for m, q in quotas.items() for s, (n, _, most) in q.items()}
    held = dict.fromkeys(span, 0)
    cuts: dict[tuple, int] = {}
    while span:
        width = {k: -(-(hi - lo) // BUCKETS) for k, (lo, hi) in span.items()}
        grid = sizes.sparkSession.createDataFrame([(m, s, lo, width[m, s]) for (m, s), (lo, _) in span.items()], "mix_name string, source string, lo long, width long")
        plan = slots([(m, 0, s, lo, hi - lo) for (m, s), (lo, hi) in span.items()])
        run = F.floor((F.col("slot") - F.col("lo")) / F.col("width")).cast("long")
        sums: dict[tuple, dict] = {k: {} for k in span}
        for r in plan.join(sizes.hint("merge"), ["source", "block"]).join(F.broadcast(grid), ["mix_name", "source"]).groupBy("mix_name", "source", run.alias("run")).agg(F.sum("size").alias("t")).collect():
            sums[r.mix_name, r.source][r.run] = r.t
        for k in list(span):
            (lo, hi), want, w = span.pop(k), quotas[k[0]][k[1]][1], width[k]
            for at in range(lo, hi, w):
                more = sums[k].get((at - lo) // w, 0)
                if held[k] + more > want:
                    break
                held[k] += more
            else:
                most = quotas[k[0]][k[1]][2]
                if hi < most:  # a few large blocks make the mean: they may stand behind the first slots
                    span[k] = (hi, min(most, 2 * hi))
                else:
                    cuts[k] = hi
                continue
            if w > 1 and more > want / 10_000:
                span[k] = (at, min(at + w, hi))
            else:
                cuts[k] = max(1, at if want - held[k] <= held[k] + more - want else min(at + w, hi))
    return cuts


def draw(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 42, least_fraction: float = LEAST_FRACTION) -> DataFrame:
    """(mix_name, shard, slot, source, copy_no, block, doc_id, tokens): the records (doc_id, source, tokens) drawn for each mix."""
    spark = sized.sparkSession
    rows = targets.where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    named = sorted({r.source for r in rows})
    blocks = durable(blocks_of(sized.where(F.col("source").isin(named)), block_tokens))
    stats = {r.source: (r.tokens, r.blocks) for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).alias("blocks")).collect()}
    mixes: dict[str, list] = {}
    for r in rows:
        mixes.setdefault(r.mix_name, []).append((r.source, r.target_share, r.max_repeats or 1))
    quotas = {name: _quotas(wanted, stats, least_fraction) for name, wanted in mixes.items()}
    keys = {x: (seed * 1_000_003 + i * 10_007) * 2_654_435_761 % (1 << 62) for i, x in enumerate(sorted((m, s) for m, q in quotas.items() for s in q))}

    def slots(plan: list[tuple]) -> DataFrame:
        full = [(m, shard, s, begin, n, int(stats[s][1]), keys[m, s]) for m, shard, s, begin, n in plan]
        return _slots(spark.createDataFrame(full, "mix_name string, shard long, source string, begin long, n long, blocks long, key long"), sum(x[4] for x in full))

    cuts = _cut(slots, blocks.groupBy("source", "block").agg(F.sum("tokens").alias("size")), quotas)
    plan = []
    for m, name in enumerate(sorted(quotas)):
        plan += [(name, *x) for x in _split_slots({s: cuts[name, s] for s in quotas[name]}, seed + m)]
    return slots(plan).join(blocks.hint("merge"), ["source", "block"]).select("mix_name", "shard", "slot", "source", "copy_no", "block", "doc_id", "tokens")


def shares(drawn: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    """Per mix and target: tokens, distinct records, the most uses of one, the actual share, the tokens the source has, and whether it is ``used_up`` (every token max_repeats times, so that it may fall short of its target)."""
    used = drawn.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("t"))
    got = used.groupBy("mix_name", "source").agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
    w = Window.partitionBy("mix_name")
    held = sized.where("source IS NOT NULL AND doc_id IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    zero = F.lit(0).cast("long")
    full = targets.join(got, ["mix_name", "source"], "left").join(held, "source", "left").fillna(0, ["tokens", "docs", "most_uses", "available_tokens"])
    whole = F.sum("tokens").over(w)
    used_up = (F.col("available_tokens") > 0) & (F.col("tokens") >= F.col("available_tokens") * F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))))
    return full.select("mix_name", "source", "target_share", "max_repeats", "available_tokens", "tokens", "docs", "most_uses", F.when(whole > 0, F.col("tokens") / whole).otherwise(zero).alias("actual_share"), used_up.alias("used_up"))


def checked_shares(report: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(mix_name, source, max_repeats, is_drawn, within_repeats, near_target) of a ``shares`` report.

    Targets of sources that hold tokens are scaled to sum to 1, as ``draw`` scales
    them; a share is near its target if it is within ``tolerance`` of it, or a source
    of the mix is used up before its target (which leaves the rest more than
    theirs)."""
    w = Window.partitionBy("mix_name")
    live = F.when((F.col("available_tokens") > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(F.lit(0.0))
    report = report.withColumn("wanted", F.try_divide(live, F.sum(live).over(w)))
    near = F.coalesce(F.abs(F.col("actual_share") - F.col("wanted")) <= tolerance, F.lit(True)) | F.max(F.col("used_up") & (F.col("actual_share") < F.col("wanted"))).over(w)
    return report.select("mix_name", "source", "max_repeats", (F.col("docs") > 0).alias("is_drawn"), (F.col("most_uses") <= F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("within_repeats"), near.alias("near_target"))
