"""Extensions beyond the map-and-fold programs: time joins, intervals, sessions and the like, from native operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time: one sort, no join.

    Rows of both sides are put together and a window looks back; of right rows at the same time the greatest values
    count. A key's rows are one window, so keys should be many.
    """
    seen = F.struct(*values)
    a = left.select(*key, time, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(seen.alias("v")).schema["v"].dataType).alias("_seen"), F.lit(1).alias("_side"))
    b = right.select(*key, time, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), seen.alias("_seen"), F.lit(0).alias("_side"))
    back = Window.partitionBy(*key).orderBy(time, "_side", "_seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last("_seen", ignorenulls=True).over(back)).filter("_side = 1")
    return both.select("_row.*", *(F.col("_last")[v].alias(v) for v in values))


def interval_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the half-open ranges that hold them: an equi-join on buckets of a width, then the exact test.

    A range is repeated for each bucket it reaches into, so width should be about that of the ranges.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = ranges.filter(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def salted_sum(df: DataFrame, key: Sequence[str], value: str, salts: int = 16) -> DataFrame:
    """A sum by key in two shuffles, for values that partial aggregation can't shrink."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*key, "_salt").agg(F.sum(value).alias("_s"))
    return part.groupBy(*key).agg(F.sum("_s").alias(value))


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of rows whose times are less than a gap apart."""
    w = F.session_window(time, gap)
    return df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
