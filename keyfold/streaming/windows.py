"""Event-time windows, keyed folds and dedup over Structured Streaming. The window functions also take batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema: Any, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, time columns as timestamps."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, key: Sequence[str], aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    return sliding(df, time, size, size, key, aggs, late)


def sliding(df: DataFrame, time: str, size: str, step: str, key: Sequence[str], aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    """(window_start, window_end, key, aggregates). late: how long rows are waited for."""
    out = _timed(df, time, late).groupBy(F.window(time, size, step).alias("w"), *key).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def session_counts(df: DataFrame, time: str, gap: str, key: Sequence[str], aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    out = _timed(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *key).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(c for c in out.columns if c != "w"))


def deduplicated(df: DataFrame, key: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; state is dropped once rows so late can't come any more."""
    df = _timed(df, time, late)
    return df.dropDuplicatesWithinWatermark(list(key)) if df.isStreaming else df.dropDuplicates(list(key))


def fold_stream(df: DataFrame, key: Sequence[str], fold: Callable[[tuple | None, pd.DataFrame], tuple], schema: str) -> DataFrame:
    """Keyed state over a stream: fold(old state or None, new rows) gives the new state, which is also given out.

    schema: the state's columns; the result has the key's columns before them.
    """
    names = [p.strip().split()[0] for p in schema.split(",")]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for rows in batches:
            now = fold(now, rows)
        state.update(tuple(now))
        yield pd.DataFrame([(*k, *now)], columns=[*key, *names])

    return df.groupBy(*key).applyInPandasWithState(run, f"{key_schema}, {schema}", schema, "update", "NoTimeout")


def keep(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Any:
    """Starts writing a stream to Parquet, once for each row even across restarts."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, as a table in memory: for tests and small results."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
