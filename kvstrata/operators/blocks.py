"""Physical layout of sorted files: delta encoding, restart points, block cuts, index entries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.functions.keys import shared_prefix, short_successor_hex, shortest_separator_hex

RESTART, BLOCK_SIZE = 16, 4096
#: Bytes of the sequence and type after each user key.
TRAILER = 8


def restart_flags(keys: DataFrame, by: list[str], interval: int = RESTART) -> DataFrame:
    """``keys`` (by, key) with ordinal, previous key and ``is_restart``: every ``interval``-th key of a file is stored whole."""
    w = Window.partitionBy(*by).orderBy("key")
    placed = keys.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("previous", F.lag("key").over(w))
    return placed.withColumn("is_restart", F.col("ordinal") % interval == 0)


def delta_stats(keys: DataFrame, by: list[str], interval: int = RESTART) -> DataFrame:
    """(by, n_keys, shared_bytes, stored_bytes): what shared prefixes save per file."""
    shared = F.when(F.col("is_restart"), F.lit(0)).otherwise(shared_prefix("previous", "key"))
    rows = restart_flags(keys, by, interval).withColumn("shared", shared.cast("long")).withColumn("size", F.octet_length("key").cast("long"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_keys"), F.sum("shared").alias("shared_bytes"), F.sum(F.col("size") - F.col("shared")).alias("stored_bytes"))


def _varint(n: np.ndarray) -> np.ndarray:
    """Bytes of numbers below 2^35 in variable-length form."""
    return 1 + sum((n >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))


#: Keys up to this length are compared as a matrix of bytes.
SHORT_KEY = 256


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """Bytes that each key has in common with the one before it, 0 for the first."""
    lens = np.array([len(k) for k in keys], np.int64)
    out = np.zeros(len(keys), np.int64)
    if len(keys) < 2:
        return out
    width = int(lens.max())
    if width <= SHORT_KEY:
        cells = np.array(keys, f"S{max(1, width)}").view(np.uint8).reshape(len(keys), -1)
        out[1:] = np.minimum(np.cumprod(cells[1:] == cells[:-1], axis=1).sum(axis=1), np.minimum(lens[1:], lens[:-1]))
    else:
        out[1:] = [len(os.path.commonprefix([x, y])) for x, y in zip(keys, keys[1:])]
    return out


def _cuts(keys: list[bytes], values: np.ndarray, block_size: int, interval: int) -> list[tuple[int, int, int]]:
    """(first, end, bytes) of the blocks of a sorted run of entries; the last one may be open still."""
    shared, lens = shared_prefixes(keys), np.array([len(k) for k in keys], np.int64)

    def size(common: np.ndarray) -> np.ndarray:
        rest = lens + TRAILER - common
        return _varint(common) + _varint(rest) + _varint(values) + rest + values

    whole, delta = size(np.zeros_like(shared)), size(shared)
    out, first, span = [], 0, 4 * interval
    while first < len(keys):
        end = min(len(keys), first + span)
        place = np.arange(end - first)
        total = 8 + np.cumsum(np.where(place % interval == 0, whole[first:end] + 4 * (place > 0), delta[first:end]))
        at = int(np.searchsorted(total, block_size))
        if at == len(total) and end < len(keys):
            span *= 2
            continue
        last = min(at, len(total) - 1)
        out.append((first, first + last + 1, int(total[last])))
        first += last + 1
    return out


def cut_blocks(kv: DataFrame, file_col: str, block_size: int = BLOCK_SIZE, interval: int = RESTART) -> DataFrame:
    """(file, block_no, first_key, last_key, n_entries, n_bytes): blocks closed once their size reaches ``block_size``.

    The cut depends on all entries before it in the file, so each file's sorted
    rows stream through one task that holds one batch and a single open block; sizes
    are added up by arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, keys, values = None, 0, [], np.empty(0, np.int64)

        def closed(whole: bool) -> list[tuple]:
            """The blocks that are closed; with ``whole``, the file ends here."""
            nonlocal block, keys, values
            cuts = _cuts(keys, values, block_size, interval)
            if cuts and not whole and cuts[-1][2] < block_size:
                cuts.pop()
            done = [(file, block + i, keys[lo].decode(), keys[hi - 1].decode(), hi - lo, n) for i, (lo, hi, n) in enumerate(cuts)]
            end = cuts[-1][1] if cuts else 0
            block, keys, values = block + len(cuts), keys[end:], values[end:]
            return done

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.cast(pc.binary_length(b.column(2)), pa.int64()), 0).to_numpy(zero_copy_only=False)
            names = pc.cast(b.column(1), pa.binary()).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            done: list[tuple] = []
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if ids[lo] != file:
                    done += closed(True)
                    file, block, keys, values = int(ids[lo]), 0, [], np.empty(0, np.int64)
                keys = keys + names[lo:hi]
                values = np.concatenate([values, sizes[lo:hi]])
            done += closed(False)
            if done:
                yield _blocks(done)
        done = closed(True)
        if done:
            yield _blocks(done)

    def _blocks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["file_id", "block_no", "first_key", "last_key", "n_entries", "n_bytes"])

    ordered = kv.where(F.col("key").isNotNull() & F.col(file_col).isNotNull()).select(F.col(file_col).cast("long"), "key", "value", "seq").repartition(file_col).sortWithinPartitions(file_col, "key", F.desc("seq"))
    return ordered.drop("seq").mapInArrow(run, "file_id long, block_no long, first_key string, last_key string, n_entries long, n_bytes long")


def index_entries(blocks: DataFrame) -> DataFrame:
    """(file_id, block_no, separator_hex): per block a short key at or above its last key and below the next block's first; after the last block a short successor."""
    following = F.lead("first_key").over(Window.partitionBy("file_id").orderBy("block_no"))
    rows = blocks.withColumn("following", following).withColumn("between", shortest_separator_hex("last_key", "following")).withColumn("after", short_successor_hex("last_key"))
    return rows.select("file_id", "block_no", F.when(F.col("following").isNotNull(), F.col("between")).otherwise(F.col("after")).alias("separator_hex"))
