"""Named handles of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keyfold.operators.partitioning import Partitioning

_ids = count()


@dataclass(eq=False)
class Collection:
    """A DataFrame under a name, with its key columns, partitioning and version.

    Data never changes: an update binds the handle to a new DataFrame and counts the version up. defaults: what a key
    that is new to the collection starts with.
    """

    name: str
    df: DataFrame | None = None
    key: tuple[str, ...] = ()
    schema: T.StructType | None = None
    defaults: dict[str, Any] = field(default_factory=dict)
    partitioning: Partitioning | None = None
    dense: bool = False
    version: int = 0
    last_checkpoint: str | None = None
    id: int = field(default_factory=lambda: next(_ids))

    def bind(self, df: DataFrame, rounds: int = 1) -> None:
        self.df = df
        self.schema = df.schema
        self.version += rounds

    def frame(self) -> DataFrame:
        if self.df is None:
            raise ValueError(f"collection {self.name} has no data yet: run the pipeline first")
        return self.df

    def placed(self) -> DataFrame:
        """The data, dealt by the collection's partitioning."""
        return self.partitioning.apply(self.frame(), self.key) if self.partitioning else self.frame()
