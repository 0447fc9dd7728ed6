"""Folds of messages into state.

A fold has two halves: an aggregate over a key's messages, which Spark computes partially before the shuffle, and the
merge of its outcome into the state's old value. All but `PythonFold` are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Fold:
    """message: the column, or expression over the message's columns, that is folded."""

    message: Column | str = "msg"

    def gather(self) -> Column:
        """Over a key's messages."""
        raise NotImplementedError

    def merge(self, old: Column, new: Column) -> Column:
        """State's value with what was gathered; new is null for keys without messages."""
        raise NotImplementedError

    def prepare(self, messages: DataFrame, key: tuple[str, ...], alone: bool) -> DataFrame:
        """Before the aggregate. alone: no other fold reads these messages."""
        return messages


class Sum(Fold):
    def gather(self) -> Column:
        return F.sum(_col(self.message))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(old + new, old, new)


class Count(Fold):
    def gather(self) -> Column:
        return F.count(F.lit(1))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


class Min(Fold):
    def gather(self) -> Column:
        return F.min(_col(self.message))

    def merge(self, old: Column, new: Column) -> Column:
        return F.least(old, new)


class Max(Fold):
    def gather(self) -> Column:
        return F.max(_col(self.message))

    def merge(self, old: Column, new: Column) -> Column:
        return F.greatest(old, new)


class Append(Fold):
    """Messages as a list. Sorted, as the order of arrival means nothing; a key's list is one row of the state."""

    def gather(self) -> Column:
        return F.array_sort(F.collect_list(_col(self.message)))

    def merge(self, old: Column, new: Column) -> Column:
        return F.array_sort(F.coalesce(F.concat(old, new), old, new))


class SetAdd(Fold):
    def gather(self) -> Column:
        return F.array_sort(F.collect_set(_col(self.message)))

    def merge(self, old: Column, new: Column) -> Column:
        return F.array_sort(F.coalesce(F.array_union(old, new), old, new))


@dataclass(frozen=True)
class TopK(Fold):
    """The k largest messages, descending; structs compare field by field."""

    k: int = 10

    def prepare(self, messages: DataFrame, key: tuple[str, ...], alone: bool) -> DataFrame:
        """Ranks are limited before the shuffle where rows over the limit can go."""
        place = F.row_number().over(Window.partitionBy(*key).orderBy(_col(self.message).desc()))
        ranked = messages.withColumn("_place", place)
        return ranked.filter(F.col("_place") <= self.k) if alone else ranked

    def gather(self) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("_place") <= self.k, _col(self.message))), asc=False)

    def merge(self, old: Column, new: Column) -> Column:
        return F.slice(F.sort_array(F.coalesce(F.concat(old, new), old, new), asc=False), 1, self.k)


@dataclass(frozen=True)
class Overwrite(Fold):
    """The message with the greatest order stays; without an order, the greatest message."""

    order: Column | str | None = None

    def gather(self) -> Column:
        m = _col(self.message)
        return F.max(m) if self.order is None else F.max_by(m, _col(self.order))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(new, old)


@dataclass(frozen=True)
class VectorSum(Fold):
    """Element-wise sum of arrays of a known length."""

    size: int = 0

    def gather(self) -> Column:
        m = _col(self.message)
        return F.array(*(F.sum(F.get(m, F.lit(i))) for i in range(self.size)))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(F.zip_with(old, new, lambda a, b: a + b), old, new)


@dataclass(frozen=True)
class Ignore(Fold):
    """Messages change nothing; new keys still come to be."""

    def gather(self) -> Column:
        return F.lit(None)

    def merge(self, old: Column, new: Column) -> Column:
        return old


@dataclass(frozen=True)
class PythonFold:
    """For updates that no expression tells: fold(old row as dict or None, messages as DataFrame) -> new row as dict.

    A key's messages meet in one call, in the order of the given columns; the function must not depend on any other.
    """

    fold: Callable[[dict[str, Any] | None, Any], dict[str, Any]]
    order: tuple[str, ...] = ()

    def run(self, state: DataFrame | None, messages: DataFrame, key: tuple[str, ...], schema: str) -> DataFrame:
        import pandas as pd

        fold, order, names = self.fold, list(self.order), list(key)

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.sort_values(order) if order else rows

        if state is None:

            def fresh(rows: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame([fold(None, whole(rows))])

            return messages.groupBy(*names).applyInPandas(fresh, schema)

        def both(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            before = old.to_dict("records")[0] if len(old) else None
            return pd.DataFrame([before if before is not None and not len(rows) else fold(before, whole(rows))])

        return state.groupBy(*names).cogroup(messages.groupBy(*names)).applyInPandas(both, schema)
