"""Medians of all earlier rows of a key, at every row."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Median:
    """The middle of a growing set of numbers: two heaps, the lower half and the upper half, log n for each number."""

    def __init__(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        elif len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float | None:
        if not self.low:
            return None
        if len(self.low) > len(self.high):
            return -self.low[0]
        return 0.5 * -self.low[0] + 0.5 * self.high[0]  # rounded once, as SQL's: the lower plus half the distance is rounded twice


def earlier_medians(df: DataFrame, keys: list[str], order: list[str], value: str, count: str = "n_before", median: str = "median_before") -> DataFrame:
    """df with the number of earlier rows of the same keys and the median of their values (the mean of the middle two; null without one).

    Nulls count as rows and are left out of the median; a null key is a key. Rows are sorted by key and order once, then read as a stream: n log n for
    a key of n rows, where a growing window frame would take the median anew at each row. Memory holds the values of one key (16 bytes each) and a batch.
    """
    n = len(keys)
    by = [F.col(c) for c in keys]
    dealt = df.withColumns({f"__k{k}": c for k, c in enumerate(by)} | {"__v": F.col(value).cast("double")})
    names = [f"__k{k}" for k in range(n)]
    ready = dealt.repartition(*names).sortWithinPartitions(*names, *order)
    at, width = ready.columns.index("__k0"), len(df.columns)
    out = T.StructType([*df.schema.fields, T.StructField(count, T.LongType()), T.StructField(median, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = object(), Median(), 0
        for batch in batches:
            own = list(zip(*(batch.column(at + k).to_pylist() for k in range(n)), strict=True))
            counts, medians = [], []
            for k, x in zip(own, batch.column(at + n).to_pylist(), strict=True):
                if k != key:
                    key, held, seen = k, Median(), 0
                counts.append(seen)
                medians.append(held.value())
                seen += 1
                if x is not None:
                    held.add(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(medians, pa.float64())], [*batch.schema.names[:width], count, median])

    return ready.mapInArrow(run, out)
