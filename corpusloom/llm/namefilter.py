"""A Bloom filter of 64-bit names: built where the rows are, of bounded size, without false negatives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrowmap import map_batches

#: Bits a name at least, and probes.
BITS_A_NAME, PROBES = 12, 5


def _places(names: np.ndarray, bits: int):
    mask = np.uint64((1 << bits) - 1)
    step = names >> np.uint64(32) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            yield (names + np.uint64(k) * step + np.uint64(k * k)) & mask


@dataclass
class NameFilter:
    """``2**bits`` bits in 64-bit words, in a broadcast."""

    shared: object
    bits: int

    @classmethod
    def of(cls, names: DataFrame, column: Column, most_bits: int) -> NameFilter | None:
        """The filter of a stored column of names; None if they need more than ``2**most_bits`` bits."""
        count = names.count()
        bits = max(10, (count * BITS_A_NAME - 1).bit_length() if count else 0)
        if bits > most_bits:
            return None

        def rows(batches):
            table = np.zeros(1 << bits >> 6, np.uint64)
            for batch in batches:
                for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            place = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(table[place].view(np.int64))], names=["place", "word"])

        found = map_batches(names.select(column), rows, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
        table = np.zeros(1 << bits >> 6, np.uint64)
        table[found["place"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return cls(names.sparkSession.sparkContext.broadcast(table), bits)

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        """For each name whether it may be one of the filter's; never false for one that is."""
        table, out = self.shared.value, np.ones(len(names), bool)
        for at in _places(names, self.bits):
            out &= table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
        return out
