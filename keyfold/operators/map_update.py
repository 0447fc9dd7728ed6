"""The engine's one primitive: map rows to keyed messages, fold messages into keyed state.

    messages = mapper(source [, side]);  state' = state, with each key's messages folded in

Mappers are functions of DataFrames, so projections, filters and joins with a side collection go through Catalyst and
only the columns they name are read. Messages are pre-aggregated before the shuffle. A fresh target needs no join; one
with data is met by an outer join on the key, to which new keys add rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.operators.folds import Fold, PythonFold

Mapper = Callable[..., DataFrame]


def flat_map(fn: Callable[[dict[str, Any]], Iterator[tuple]], schema: str) -> Mapper:
    """A mapper from a Python function of a row to message tuples, run over Arrow batches."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            yield pd.DataFrame([m for row in rows.to_dict("records") for m in fn(row)], columns=names)

    return lambda df: df.mapInPandas(run, schema)


def partition_map(fn: Callable[[Iterator[Any]], Iterator[Any]], schema: str, batches: str = "pandas") -> Mapper:
    """A mapper from a function of a partition's batches, pandas or Arrow."""
    return (lambda df: df.mapInPandas(fn, schema)) if batches == "pandas" else (lambda df: df.mapInArrow(fn, schema))


def fold_messages(
    messages: DataFrame,
    state: DataFrame | None,
    key: tuple[str, ...],
    update: Mapping[str, Fold] | PythonFold,
    defaults: Mapping[str, Any] | None = None,
    existing_only: bool = False,
    schema: str | None = None,
) -> DataFrame:
    """State with messages folded in.

    update: a fold for each state column that messages change. defaults: values of columns for new keys. existing_only:
    a message to a key that the state hasn't got is an error, as for dense ranges.
    """
    missing = [k for k in key if k not in messages.columns]
    if missing:
        raise ValueError(f"messages lack key columns {missing}: {messages.columns}")
    messages = messages.dropna(subset=list(key))
    if isinstance(update, PythonFold):
        return update.run(state, messages, key, schema or state.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    defaults = dict(defaults or {})
    if state is not None:
        unknown = [c for c in update if c not in state.columns]
        if unknown:
            raise ValueError(f"the state has no columns {unknown}: {state.columns}")
    for f in update.values():
        messages = f.prepare(messages, key, len(update) == 1)
    gathered = messages.groupBy(*key).agg(*(f.gather().alias(f"_new_{c}") for c, f in update.items()))
    start = lambda c, kind=None: F.lit(defaults[c]) if c in defaults else F.lit(None) if kind is None else F.lit(None).cast(kind)
    if state is None:
        others = [c for c in defaults if c not in update]
        return gathered.select(*key, *(update[c].merge(start(c), F.col(f"_new_{c}")).alias(c) if c in defaults else F.col(f"_new_{c}").alias(c) for c in update), *(start(c).alias(c) for c in others))
    kinds = {f.name: f.dataType for f in state.schema.fields}
    if existing_only:
        every = gathered.join(state.withColumn("_old", F.lit(True)), list(key), "left")
        checked = F.when(F.col("_old").isNull(), F.raise_error(F.lit("a message has a key out of range")).cast("boolean")).otherwise(F.lit(True))
        known = every.select(*key, *(F.col(f"_new_{c}") for c in update), checked.alias("_known"))
        joined = state.withColumn("_old", F.lit(True)).join(known.filter("_known"), list(key), "left")
    else:
        joined = state.withColumn("_old", F.lit(True)).join(gathered, list(key), "full_outer")

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        old = F.when(F.col("_old"), F.col(c)).otherwise(start(c, kinds[c])) if not existing_only else F.col(c)
        if c not in update:
            return old.alias(c)
        return update[c].merge(old, F.col(f"_new_{c}")).cast(kinds[c]).alias(c)

    return joined.select(*(value(c) for c in state.columns))


def map_update(source: DataFrame, state: DataFrame | None, key: tuple[str, ...], mapper: Mapper, update: Mapping[str, Fold] | PythonFold, defaults: Mapping[str, Any] | None = None, **more: Any) -> DataFrame:
    return fold_messages(mapper(source), state, key, update, defaults, **more)


def map_with_update(
    source: DataFrame, side: DataFrame, state: DataFrame | None, key: tuple[str, ...], mapper: Mapper, update: Mapping[str, Fold] | PythonFold, defaults: Mapping[str, Any] | None = None, broadcast_rows: int | None = None, **more: Any
) -> DataFrame:
    """map_update whose mapper also reads a side collection: mapper(source, side).

    broadcast_rows: a bound of the side's rows; it is broadcast if it has no more, which is counted.
    """
    if broadcast_rows is not None and side.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = F.broadcast(side)
    return fold_messages(mapper(source, side), state, key, update, defaults, **more)


def lookup(keys: DataFrame, table: DataFrame, key: tuple[str, ...], defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of a table for distinct keys; keys that it hasn't got come with defaults. The table itself is as before."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    found = keys.select(*key).dropna().distinct().join(table.withColumn("_old", F.lit(True)), list(key), "left")
    value = lambda c: F.col(c) if c in key else F.when(F.col("_old"), F.col(c)).otherwise(F.lit((defaults or {}).get(c)).cast(kinds[c])).alias(c)
    return found.select(*(value(c) for c in table.columns))
