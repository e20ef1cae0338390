"""Bit tables: what cannot be in a column of hashes, for scans that should let little through.

A table has about 8 bits for each hash and probe, and at most 2**MOST_BITS bits (64 MB); what reaches the driver and the
workers is bounded by that, however many hashes there are. Beyond, it lets more through, which costs rows in the
exact join that follows, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 29
_STEP = 17


class BitTable:
    """The bits of a column of longs that are hashes; ``n`` is about how many there are."""

    def __init__(self, hashes: DataFrame, n: int, probes: int = 1, least_bits: int = LEAST_BITS):
        bits = min(max((8 * probes * n).bit_length(), least_bits), MOST_BITS)
        self.mask, self.probes = (1 << bits) - 1, probes
        slots = ", ".join(f"shiftrightunsigned({hashes.columns[0]}, {p * _STEP}) & {self.mask}L" for p in range(probes))
        rows = hashes.selectExpr(f"explode(array({slots})) as slot").selectExpr("cast(shiftright(slot, 6) as int) as word", "shiftleft(1L, cast(slot & 63 as int)) as bit")
        rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << (bits - 6), np.int64)
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.words = out.view(np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False where a hash certainly is not in the column."""
        out = None
        for p in range(self.probes):
            at = ((hashes >> np.uint64(p * _STEP)) & np.uint64(self.mask)).astype(np.int64)
            hit = ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            out = hit if out is None else out & hit
        return out
