"""A blocked Bloom filter over 64-bit keys, built by Spark.

The filter is an array of 256-bit blocks.  The high half of a mixed key picks
the block, the low half one bit in each of its eight 32-bit lanes, so a
lookup touches one cache line.  Its size is a parameter with a fixed upper
bound: with more keys than it was made for it passes more false positives,
which the caller's exact join removes, and it never misses a key.

Partitions build partial filters, which are united slice by slice in Spark;
only the finished filter (at most ``max_bytes``) reaches the driver, to be
broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import finalise

#: Odd multipliers, one for each lane of a block.
LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D,
                  0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
BLOCK_BYTES = 32
MAX_BYTES = 4 << 20
SLICES = 16


def _spots(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each key, its bit in each lane)."""
    h = finalise(keys.astype(np.uint64, copy=False))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * LANES[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), bit.astype(np.uint32)


def add(words: np.ndarray, keys: np.ndarray) -> None:
    """Set the keys' bits; ``words`` has shape (blocks, 8)."""
    block, bit = _spots(keys, len(words))
    for lane in range(8):
        np.bitwise_or.at(words[:, lane], block, np.uint32(1) << bit[:, lane])


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter (all that are, few others)."""
    if not len(keys):
        return np.zeros(0, bool)
    block, bit = _spots(keys, len(words))
    want = np.uint32(1) << bit
    return ((words[block] & want) == want).all(axis=1)


def blocks_for(n_keys: int, bits_per_key: int = 16, max_bytes: int = MAX_BYTES) -> int:
    """A multiple of SLICES; never more than ``max_bytes``."""
    wanted = -(-n_keys * bits_per_key // (8 * BLOCK_BYTES))
    most = max_bytes // BLOCK_BYTES
    return -(-max(1, min(wanted, most)) // SLICES) * SLICES


def build(keys: DataFrame, n_keys: int, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of a one-column DataFrame of 64-bit keys."""
    column = keys.columns[0]
    blocks = blocks_for(n_keys, max_bytes=max_bytes)
    width = blocks // SLICES

    def fill(batches):
        words = np.zeros((blocks, 8), np.uint32)
        for batch in batches:
            add(words, batch[column].drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
        for s in range(SLICES):
            part = words[s * width:(s + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "bits": [part.tobytes()]})

    def unite(table: pa.Table) -> pa.Table:
        out = np.zeros(width * 8, np.uint32)
        for raw in table["bits"].to_pylist():
            out |= np.frombuffer(raw, np.uint32)
        return pa.table({"slice": table["slice"][:1], "bits": [out.tobytes()]})

    words = np.zeros((blocks, 8), np.uint32)
    united = keys.mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInArrow(unite, "slice int, bits binary")
    for r in united.collect():  # max_bytes together
        words[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["bits"], np.uint32).reshape(-1, 8)
    return words


def probe(spark, words: np.ndarray):
    """An Arrow function: does the filter pass this 64-bit key? (null: no)"""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def passes(key: pa.Array) -> pa.Array:
        return pa.array(contains(shared.value, key.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
                        & ~key.is_null().to_numpy(zero_copy_only=False))
    return passes


def passing(df: DataFrame, key: Column, words: np.ndarray) -> DataFrame:
    """The rows whose key may be in the filter."""
    return df.where(probe(df.sparkSession, words)(key))
