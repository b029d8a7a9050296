"""Filters of hashes, of bounded size, that go to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import parts

#: Bits of a filter for each member, and bytes that a filter takes at most; beyond that it lets more through.
FILTER_BITS, FILTER_BYTES = 24, 64 << 20


class Members:
    """Which hashes are members; says yes to all of them, and to few others while it is not too full."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (bits.size.bit_length() - 1))

    @staticmethod
    def words(n: int, most: int = FILTER_BYTES) -> int:
        """64-bit words for ``n`` members, a power of two."""
        return min(1 << max(4, (n * FILTER_BITS // 64).bit_length()), 1 << ((most // 8).bit_length() - 1))

    @staticmethod
    def _mask(h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low)) | (one << ((h >> np.uint64(18)) & low))

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = self._mask(h)
        return (self.bits[(h >> self.shift).astype(np.int64)] & mask) == mask


def members_of(hashes: DataFrame, most: int = FILTER_BYTES) -> Members:
    """A filter of the hashes ``h``, made in tasks by ranges of its words."""
    spark = hashes.sparkSession
    n = Members.words(hashes.count(), most)
    ranges = min(n, 64)
    each = n // ranges
    shift = np.uint64(64 - (n.bit_length() - 1))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, h = batch["part"].to_numpy(), batch["h"].to_numpy().view(np.uint64)
            for k in np.unique(part).tolist():
                own = h[part == k]
                words = found.setdefault(k, np.zeros(each, np.uint64))
                np.bitwise_or.at(words, (own >> shift).astype(np.int64) - k * each, Members._mask(own))
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([w.tobytes() for _, w in rows], pa.binary())], ["part", "words"])

    place = F.shiftrightunsigned("h", 64 - (ranges.bit_length() - 1)).cast("int") if ranges > 1 else F.lit(0)
    rows = hashes.select("h", place.alias("part")).repartition(min(ranges, parts(spark)), "part").mapInArrow(made, "part int, words binary")
    bits = np.zeros(n, np.uint64)
    for k, words in rows.collect():
        bits[k * each : (k + 1) * each] |= np.frombuffer(words, np.uint64)
    return Members(bits)
