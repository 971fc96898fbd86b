"""Bit filters of a fixed size over 64-bit hashes: they thin out rows before a join and never lose one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKET = 1 << 15  # bits of one row of Spark's bitmap functions
LEAST_BITS, MOST_BITS = 20, 27  # 128 kB to 16 MB


def width_for(n: int, spread: int = 256) -> int:
    """Bits of a place in a filter with `spread` places for each of n hashes, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (n * spread).bit_length()))


def bits_of(hashes: DataFrame, width: int) -> np.ndarray:
    """A filter of 2**width bits with one set for each hash of the column `h`."""
    # the bitmap functions count from one
    place = F.shiftrightunsigned("h", 64 - width) + 1
    placed = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in placed.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")).collect():  # the filter itself
        low = (r["bucket"] - 1) * (_BUCKET // 8)
        out[low : low + _BUCKET // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be in a filter."""
    width = (len(bits) * 8).bit_length() - 1
    place = (h >> np.uint64(64 - width)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
