"""Cache-line blocked Bloom filters over 32-bit key hashes.

Null or empty hash lists give an empty filter, which matches nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LINE_BITS = 512
BITS_PER_KEY = 10


def probes_for(bits_per_key: int) -> int:
    """Bits set per key: ln 2 times the bits per key, within 1..30."""
    return min(30, max(1, int(bits_per_key * 0.69 + 0.5)))


def _places(hashes: np.ndarray, lines: int, probes: int) -> np.ndarray:
    """Bit places (keys x probes): one line per key, then steps of the rotated hash within it."""
    h = hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    step = (h >> np.uint64(17)) | (h << np.uint64(15) & np.uint64(0xFFFFFFFF))
    walk = h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)
    return ((h % np.uint64(lines)) * np.uint64(LINE_BITS))[:, None] + (walk & np.uint64(LINE_BITS - 1))


def build(hashes: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> tuple[int, int, bytes]:
    """(lines, probes, bits) for the hashes of a file's keys."""
    if not len(hashes):
        return 0, 0, b""
    lines = -(-len(hashes) * bits_per_key // LINE_BITS)
    lines += lines % 2 == 0
    bits = np.zeros(lines * LINE_BITS, np.uint8)
    bits[_places(hashes, lines, probes_for(bits_per_key)).ravel().astype(np.int64)] = 1
    return lines, probes_for(bits_per_key), np.packbits(bits, bitorder="little").tobytes()


def may_match(hashes: np.ndarray, lines: int, probes: int, bits: bytes) -> np.ndarray:
    """Per hash: whether the key may be in the filter."""
    if not lines:
        return np.zeros(len(hashes), bool)
    places = _places(hashes, lines, probes).astype(np.int64)
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[places].all(axis=1)


def build_filters(blocks: DataFrame, id_col: str, hashes_col: str, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(id, n_hashes, lines, probes, bits) from one list of hashes per file, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(len(h or ()), *build(np.array(h or (), np.int64), bits_per_key)) for h in b.column(1).to_pylist()]
            ns, lines, probes, bits = zip(*made) if made else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (ns, lines, probes)], pa.array(bits, pa.binary())], names=[id_col, "n_hashes", "lines", "probes", "bits"])

    return blocks.select(id_col, hashes_col).mapInArrow(run, f"{id_col} {dict(blocks.dtypes)[id_col]}, n_hashes long, lines long, probes long, bits binary")


def probe_filters(rows: DataFrame, id_col: str, hashes_col: str) -> DataFrame:
    """(id, n_probed, n_misses) for rows with a filter (lines, probes, bits) and a list of hashes to probe it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            probed, missed = [], []
            for hashes, lines, probes, bits in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                asked = np.array(hashes or (), np.int64)
                probed.append(len(asked))
                missed.append(int((~may_match(asked, lines, probes, bits)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probed, pa.int64()), pa.array(missed, pa.int64())], names=[id_col, "n_probed", "n_misses"])

    return rows.select(id_col, hashes_col, "lines", "probes", "bits").mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, n_probed long, n_misses long")
