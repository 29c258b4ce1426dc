"""Items of varying length in containers of fixed capacity.

Method: best fit under conflicts, copies first, then longest first.  Open containers stand ordered
by their residual; each carries bitmaps of its sources and of its duplicate
clusters.  The search starts at the least residual that takes the item and goes
on to the next larger one until the container is compatible: the item's cluster
is not in it yet (copies of a text spread over containers) and its source is in
it or it has fewer than ``max_sources`` of them.

Items are dealt by a hash of what they are (id, source, cluster, size, and a
number among wholly equal rows) to shards of about ``shard_items``, so the result
does not depend on how the rows are partitioned.  Shards are packed
independently: no task holds more than a shard whatever source or cluster is hot,
and each shard costs at most its last few containers.  A cluster
with more members in a shard than the shard needs containers (or, where the bound
on sources binds, than containers can hold its source) is split into as few parts
as that takes, as otherwise copies would force containers that stay nearly empty.

Defined results: items above the capacity are cut into full pieces (each its own
container) and a rest, which is packed as an item; no other item is cut.  Items
of size 0 (null or empty texts) are assigned too, ids may be null or repeated,
and a null source counts as a source of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.tokens import VOCABULARY, with_tokens
from kvstrata.sources.scratch import durable

ITEM = ["doc_id", "source", "cluster", "tokens"]
SHARD_ITEMS = 8192
MAX_SOURCES = 8


class BestFit:
    """Open containers of one capacity, ordered by residual."""

    def __init__(self, capacity: int, max_sources: int | None = None):
        self.capacity, self.max_sources = capacity, max_sources
        self.open: list[tuple[int, int]] = []  # (residual, container)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int = 0, cluster: int = 0) -> int:
        """The container that takes an item; source and cluster are bitmaps with at most one bit."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            bin_no = self.open[at][1]
            held = self.sources[bin_no]
            if not self.clusters[bin_no] & cluster and (held & source or self.max_sources is None or held.bit_count() < self.max_sources):
                residual = self.open.pop(at)[0] - size
                self.sources[bin_no] |= source
                self.clusters[bin_no] |= cluster
                insort(self.open, (residual, bin_no))
                return bin_no
            at += 1
        bin_no = self.fresh(source, cluster)
        insort(self.open, (self.capacity - size, bin_no))
        return bin_no

    def fresh(self, source: int = 0, cluster: int = 0) -> int:
        """A new container that is not open to further items."""
        self.sources.append(source)
        self.clusters.append(cluster)
        return len(self.sources) - 1


def pack_shard(items: list[tuple], capacity: int, max_sources: int | None, cut: bool = True) -> list[tuple[int, int, int, int]]:
    """Pack (id, size, source, cluster) items: (index of the item, piece, size of the piece, container)."""
    pieces: list[tuple[int, int, int]] = []  # (size, index, piece)
    bins, out = BestFit(capacity, max_sources), []
    for i, (_, size, _, _) in enumerate(items):
        if size <= capacity or not cut:
            pieces.append((size, i, 0))
            continue
        for piece in range(size // capacity):
            out.append((i, piece, capacity, bins.fresh()))
        if size % capacity:
            pieces.append((size % capacity, i, size // capacity))
    seen: dict = {}
    for size, i, _ in pieces:
        if size:
            seen[items[i][3]] = seen.get(items[i][3], 0) + 1
    seen.pop(None, None)
    # Copies go first, while every container is open: at the end, no residual would be left that is free of their cluster.
    pieces.sort(key=lambda x: (seen.get(items[x[1]][3], 0) < 2, -x[0], items[x[1]][3] or 0, items[x[1]][0] is None, items[x[1]][0] or 0, x[1]))
    source_bit: dict = {}
    volume: dict = {}
    for size, i, _ in pieces:
        source_bit.setdefault(items[i][2], 1 << len(source_bit))
        volume[items[i][2]] = volume.get(items[i][2], 0) + size
    needed = max(1, sum(volume.values()) // capacity)
    # Containers over which copies of a source may spread: if few sources share one, the others must keep room.
    loose = max_sources is None or max_sources >= len(volume)
    hosts = {s: needed if loose else max(1, min(needed, v * max_sources // capacity)) for s, v in volume.items()}
    members: dict = {}
    for size, i, _ in pieces:
        _, _, source, cluster = items[i]
        if size and seen.get(cluster, 0) > 1:  # singletons and items of no size cannot conflict
            of = members.setdefault(cluster, {})
            of[source] = of.get(source, 0) + 1
    # A cluster's parts, as few as its copies as a whole and those of each source take; copies are dealt to them source by source.
    parts = {c: max(-(-sum(of.values()) // needed), *(-(-n // hosts[s]) for s, n in of.items())) for c, of in members.items()}
    dealt: dict = {}
    for c, of in members.items():
        n = 0
        for s, m in of.items():
            dealt[c, s] = n
            n += m
    cluster_bit: dict = {}
    for size, i, piece in pieces:
        _, _, source, cluster = items[i]
        bit = 0
        if size and cluster in members:
            bit = cluster_bit.setdefault((cluster, dealt[cluster, source] % parts[cluster]), 1 << len(cluster_bit))
            dealt[cluster, source] += 1
        if size > capacity:
            out.append((i, piece, size, bins.fresh()))
        else:
            out.append((i, piece, size, bins.place(size, source_bit[source], bit)))
    return out


def sized_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, cluster, tokens); a cluster is a hash of the exact text."""
    keep = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("cluster"), F.col(text_col).alias("_text"))
    return with_tokens(keep, "_text", ["doc_id", "source", "cluster"], vocabulary=vocabulary)


def numbered_copies(items: DataFrame, step: int = 4096) -> DataFrame:
    """``items`` with ``_copy``, which numbers wholly equal rows from 0.

    Equal rows are counted map-side and made again from their count, so a row that
    is repeated without end is neither sorted nor held by one task."""
    counted = items.groupBy(*items.columns).agg(F.count("*").alias("_n"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))).alias("_from"))
    return runs.select(*items.columns, F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + step) - 1)).alias("_copy"))


def _stable(row: tuple) -> tuple:
    """An order of (id, size, source, cluster) rows in which only equal rows tie; nulls come last."""
    return tuple((x is None, 0 if x is None else x) for x in row)


def pack(items: DataFrame, specs: dict[str, int], shard_items: int = SHARD_ITEMS, max_sources: int | None = MAX_SOURCES) -> DataFrame:
    """(spec_name, container_id, doc_id, piece_no, tokens) for items (doc_id, source, cluster, tokens) and each named capacity."""
    items = durable(items.select(*ITEM))
    shards = max(1, -(-items.count() // shard_items))
    spread = numbered_copies(items).withColumn("shard", F.pmod(F.xxhash64(*ITEM, "_copy"), F.lit(shards)).cast("long")).drop("_copy")
    id_type = dict(items.dtypes)["doc_id"]

    def run(pdf):
        import pandas as pd

        shard = int(pdf["shard"].iloc[0])
        ids = pdf["doc_id"].tolist()
        ids = [None if x is None or x != x else int(x) for x in ids] if id_type in ("bigint", "int") else ids
        clusters = [None if x is None or x != x else int(x) for x in pdf["cluster"].tolist()]
        rows = sorted(zip(ids, pdf["tokens"].tolist(), pdf["source"].tolist(), clusters), key=_stable)
        out = []
        for name, capacity in specs.items():
            out += [(name, (shard << 32) | b, rows[i][0], piece, size) for i, piece, size, b in pack_shard(rows, capacity, max_sources)]
        return pd.DataFrame({"spec_name": [x[0] for x in out], "container_id": [x[1] for x in out], "doc_id": pd.array([x[2] for x in out], dtype="Int64" if id_type in ("bigint", "int") else object), "piece_no": [x[3] for x in out], "tokens": [x[4] for x in out]})

    return spread.groupBy("shard").applyInPandas(run, f"spec_name string, container_id long, doc_id {id_type}, piece_no int, tokens long")


def read_specs(specs: DataFrame, most: int = 1000) -> dict[str, int]:
    """Named capacities; null names or capacities and those below 1 are left out.  The table is a parameter list of bounded size."""
    rows = specs.where("spec_name IS NOT NULL AND capacity_tokens >= 1").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} container specs")
    return {r.spec_name: int(r.capacity_tokens) for r in sorted(rows, key=lambda r: r.spec_name)}


def fill_report(assigned: DataFrame, specs: dict[str, int]) -> DataFrame:
    """Per spec: containers, tokens, the least possible number of containers, and the fill."""
    capacity = F.create_map(F.lit(""), F.lit(1), *[F.lit(x) for kv in specs.items() for x in kv])
    used = assigned.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("held"))
    total = used.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    total = total.withColumn("capacity_tokens", capacity[F.col("spec_name")].cast("long"))
    return total.select("spec_name", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def checked_assignment(items: DataFrame, assigned: DataFrame, specs: dict[str, int]) -> DataFrame:
    """(spec_name, capacity_tokens, n_docs, n_whole, n_overfull): the ids of ``items``, those whose pieces are as many and as large as they must be, and containers above the capacity.

    ``items`` has one row per id; ids that are null are left out."""
    capacity = F.create_map(F.lit(""), F.lit(1), *[F.lit(x) for kv in specs.items() for x in kv])[F.col("spec_name")].cast("long").alias("capacity_tokens")
    sizes = items.where("doc_id IS NOT NULL").select("doc_id", F.col("tokens").alias("size"))
    placed = assigned.where("doc_id IS NOT NULL").groupBy("spec_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("held")).select("*", capacity)
    whole = (F.col("held") == F.col("size")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens"))))
    docs = placed.join(sizes, "doc_id").groupBy("spec_name", "capacity_tokens").agg(F.count("*").alias("n_docs"), F.count_if(whole).alias("n_whole"))
    held = assigned.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("held")).select("*", capacity)
    over = held.groupBy("spec_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("n_overfull"))
    return docs.join(over, "spec_name").select("spec_name", "capacity_tokens", "n_docs", "n_whole", "n_overfull")
