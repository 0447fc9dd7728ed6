"""Ways to deal rows to partitions.

A scheme is a column for the partition's number, so what depends on it is the same on any cluster. `apply` also moves
rows together; results never depend on whether it was called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Partitioning:
    n: int
    number: Callable[[tuple[str, ...]], Column] | None = None  # None: Spark's own hash of the key

    def column(self, key: tuple[str, ...]) -> Column:
        return self.number(key) if self.number else F.pmod(F.hash(*key), F.lit(self.n))

    def apply(self, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        if not key:
            return df.repartition(self.n)
        return df.repartition(self.n, self.number(key)) if self.number else df.repartition(self.n, *key)


def hashed(n: int) -> Partitioning:
    return Partitioning(n)


def round_robin(n: int) -> Partitioning:
    """For an integer key: its rest modulo n."""
    return Partitioning(n, lambda key: F.pmod(F.col(key[0]), F.lit(n)))


def ranges(bounds: list[tuple[int, int]]) -> Partitioning:
    """For an integer key: half-open ranges, in order and without gaps, as wide as the first but for the last."""
    if not bounds or any(hi <= lo for lo, hi in bounds):
        raise ValueError("ranges are empty")
    start, width = bounds[0][0], bounds[0][1] - bounds[0][0]
    for (_, end), (lo, hi) in zip(bounds, bounds[1:]):
        if lo != end:
            raise ValueError("ranges leave a gap or overlap")
        if hi - lo != width and (lo, hi) != bounds[-1] or hi - lo > width:
            raise ValueError("ranges differ in width")
    return Partitioning(len(bounds), lambda key: F.least(F.lit(len(bounds) - 1), F.floor((F.col(key[0]) - start) / width)).cast("int"))


def custom(n: int, number: Callable[..., Column]) -> Partitioning:
    """A partition number from the key columns."""
    return Partitioning(n, lambda key: number(*map(F.col, key)))


def blocks(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Dense integer keys as rows (block, values): arrays of `size` neighbouring values, the last one shorter."""
    rows = df.groupBy(F.floor(F.col(key) / size).cast("long").alias("block"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]).alias("values"))


def shuffled(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly, whatever their keys."""
    return df.repartition(n)
