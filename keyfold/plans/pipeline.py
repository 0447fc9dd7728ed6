"""A deferred program over collections.

Calls record plans; `run` executes them in the order that what they read and write asks for, one after another or, as
`wide`, those of a level at the same time. Most plans only extend a collection's DataFrame; jobs run for iterations,
writes, counts and the like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold import storage
from keyfold.operators import iterate as loops
from keyfold.operators.folds import Fold, PythonFold
from keyfold.operators.map_update import Mapper, fold_messages
from keyfold.operators.partitioning import Partitioning, hashed
from keyfold.plans.collection import Collection
from keyfold.plans.dag import Dag
from keyfold.sources import text as text_source


@dataclass
class Plan:
    """A recorded step. Modifiers return the plan itself."""

    id: int
    name: str
    reads: tuple[Collection, ...]
    writes: tuple[Collection, ...]
    execute: Callable[["Plan"], Any] = field(repr=False)
    rounds: int = 1
    staleness: int = 0
    checkpoint_every: int = 0
    checkpoint_path: str | None = None
    until: Callable[[DataFrame, DataFrame], bool] | None = None
    result: Any = None

    def set_iter(self, rounds: int) -> "Plan":
        if rounds < 0:
            raise ValueError("rounds aren't negative")
        self.rounds = rounds
        return self

    def set_staleness(self, staleness: int) -> "Plan":
        """Accepted as a bound; rounds run as supersteps, which keep any bound."""
        if staleness < 0:
            raise ValueError("staleness isn't negative")
        self.staleness = staleness
        return self

    def set_combine(self, mode: str | int = "direct") -> "Plan":
        """Spark always combines before the shuffle, so modes (none, direct, shuffle, or a time in ms) agree."""
        if not (mode in ("none", "direct", "shuffle") or isinstance(mode, int) and mode >= -1):
            raise ValueError(f"unknown mode {mode}")
        return self

    def set_checkpoint_interval(self, every: int, path: str | None = None) -> "Plan":
        self.checkpoint_every, self.checkpoint_path = every, path
        return self

    def set_until(self, until: Callable[[DataFrame, DataFrame], bool]) -> "Plan":
        self.until = until
        return self

    def set_name(self, name: str) -> "Plan":
        self.name = name
        return self


class Pipeline:
    def __init__(self, spark: SparkSession, runner: str = "sequential") -> None:
        if runner not in ("sequential", "wide"):
            raise ValueError(f"unknown runner {runner}")
        self.spark, self.runner = spark, runner
        self._plans: list[Plan] = []
        self._collections: list[Collection] = []
        self._done: set[int] = set()

    # collections

    def collection(self, name: str = "", df: DataFrame | None = None, key: Sequence[str] = (), **more: Any) -> Collection:
        c = Collection(name or f"collection{len(self._collections)}", df, tuple(key), df.schema if df is not None else None, **more)
        self._collections.append(c)
        return c

    def distribute(self, data: Iterable[Any], schema: T.StructType | str, num_parts: int = 1, name: str = "") -> Collection:
        """Driver data, unkeyed; element i is dealt to partition i modulo num_parts."""
        c = self.collection(name)

        def execute(plan: Plan) -> None:
            # single values stand for rows of one column
            rows = [tuple(x) if isinstance(x, (tuple, list, Row)) else (x,) for x in data]
            df = self.spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("_i", T.LongType()), T.StructField("_r", _struct(schema))]))
            df = df.repartitionById(num_parts, F.pmod("_i", F.lit(num_parts)).cast("int")) if hasattr(df, "repartitionById") else df.repartition(num_parts, F.pmod("_i", F.lit(num_parts)))
            c.bind(df.sortWithinPartitions("_i").select("_r.*"))

        self._record(f"distribute {c.name}", (), (c,), execute)
        return c

    def distribute_by_key(self, data: Iterable[Any], schema: T.StructType | str, key: Sequence[str], num_parts: int = 1, name: str = "") -> Collection:
        """Driver data by key; of several elements with a key the last one stays."""
        c = self.collection(name, key=key, partitioning=hashed(num_parts))

        def execute(plan: Plan) -> None:
            rows = [(i, tuple(x)) for i, x in enumerate(data)]
            df = self.spark.createDataFrame(rows, T.StructType([T.StructField("_i", T.LongType()), T.StructField("_r", _struct(schema))]))
            c.bind(df.groupBy(*(F.col(f"_r.{k}") for k in key)).agg(F.max_by("_r", "_i").alias("_r")).select("_r.*"))

        self._record(f"distribute_by_key {c.name}", (), (c,), execute)
        return c

    def placeholder(self, schema: T.StructType | str, key: Sequence[str], num_parts: int = 1, partitioning: Partitioning | None = None, defaults: Mapping[str, Any] | None = None, name: str = "") -> Collection:
        """An empty keyed collection. defaults: what new keys start with."""
        c = self.collection(name, key=key, partitioning=partitioning or hashed(num_parts), defaults=dict(defaults or {}))
        c.schema = _struct(schema)
        return c

    def range_placeholder(self, n: int, schema: T.StructType | str, key: str = "key", defaults: Mapping[str, Any] | None = None, partitioning: Partitioning | None = None, name: str = "") -> Collection:
        """All keys from 0 to n - 1 with their defaults; messages to other keys are errors."""
        c = self.collection(name, key=(key,), partitioning=partitioning, defaults=dict(defaults or {}), dense=True)
        c.schema = _struct(schema)

        def execute(plan: Plan) -> None:
            kinds = {f.name: f.dataType for f in c.schema.fields}
            c.bind(self.spark.range(n).select(*(F.col("id").cast(kinds[k]).alias(k) if k == key else F.lit(c.defaults.get(k)).cast(kinds[k]).alias(k) for k in kinds)))

        self._record(f"range_placeholder {c.name}", (), (c,), execute)
        return c

    # sources and sinks

    def load(self, url: str, parse: Callable[[DataFrame], DataFrame] = lambda lines: lines, max_lines_per_part: int | None = None, name: str = "") -> Collection:
        """Lines of a folder of text files, through parse (a function of the DataFrame with column `value`)."""
        return self._loaded(name or "load", lambda: parse(text_source.lines(self.spark, url, max_lines_per_part)))

    def load_wholefiles(self, url: str, parse: Callable[[DataFrame], DataFrame] = lambda records: records, name: str = "") -> Collection:
        """Records of whole files, each ended by a line `</doc>`."""
        return self._loaded(name or "load_wholefiles", lambda: parse(text_source.records(self.spark, url)))

    def load_block_meta(self, url: str, name: str = "") -> Collection:
        """Lines, read only where a plan needs them, with their file's path."""
        return self._loaded(name or "load_block_meta", lambda: text_source.lazy_lines(self.spark, url))

    def load_wholefiles_meta(self, url: str, name: str = "") -> Collection:
        """Whole files, read only where a plan needs them: path and value."""
        return self._loaded(name or "load_wholefiles_meta", lambda: text_source.whole_files(self.spark, url))

    def write(self, c: Collection, url: str, fmt: Callable[[DataFrame], DataFrame]) -> Plan:
        """A text file per partition of what fmt makes of the data, a column of lines."""
        return self._record(f"write {c.name}", (c,), (), lambda plan: text_source.write_lines(fmt(c.frame()), url))

    def checkpoint(self, c: Collection, url: str) -> Plan:
        def execute(plan: Plan) -> None:
            storage.save(c.frame(), url)
            c.last_checkpoint = url

        return self._record(f"checkpoint {c.name}", (c,), (), execute)

    def load_checkpoint(self, c: Collection, url: str | None = None) -> Plan:
        """Binds the collection to a snapshot: that at url, or its last one."""

        def execute(plan: Plan) -> None:
            where = url or c.last_checkpoint
            if where is None:
                raise ValueError(f"{c.name} has no checkpoint")
            c.bind(storage.load(self.spark, where))

        return self._record(f"load_checkpoint {c.name}", (), (c,), execute)

    # computing

    def map_update(self, source: Collection, target: Collection, mapper: Mapper, update: Mapping[str, Fold] | PythonFold) -> Plan:
        """mapper(source's DataFrame) gives messages with the target's key columns; update folds them in."""
        return self._update(f"map_update {source.name} {target.name}", source, None, target, mapper, update)

    map_part_update = map_update  # mappers see whole partitions if they come from operators.map_update.partition_map

    def map_with_update(self, source: Collection, side: Collection, target: Collection, mapper: Mapper, update: Mapping[str, Fold] | PythonFold, broadcast_rows: int | None = None) -> Plan:
        """As map_update, with mapper(source, side). broadcast_rows: the side is broadcast if it has no more rows."""
        return self._update(f"map_with_update {source.name} {side.name} {target.name}", source, side, target, mapper, update, broadcast_rows)

    map_part_with_update = map_with_update

    def foreach(self, c: Collection, f: Callable[[Row], None]) -> Plan:
        return self._record(f"foreach {c.name}", (c,), (), lambda plan: c.frame().foreach(f))

    def count(self, c: Collection) -> Plan:
        """The number of elements, as the plan's result."""

        def execute(plan: Plan) -> None:
            plan.result = c.frame().count()

        return self._record(f"count {c.name}", (c,), (), execute)

    def sort_each_partition(self, c: Collection) -> Plan:
        def execute(plan: Plan) -> None:
            if not c.key:
                raise ValueError(f"{c.name} has no key to sort by")
            c.bind(c.placed().sortWithinPartitions(*c.key), 0)

        return self._record(f"sort_each_partition {c.name}", (c,), (c,), execute)

    # running

    @property
    def plans(self) -> list[Plan]:
        return list(self._plans)

    @property
    def collections(self) -> list[Collection]:
        return list(self._collections)

    @property
    def dag(self) -> Dag:
        dag = Dag()
        for p in self._plans:
            dag.add(p.id, p.name, [c.id for c in p.reads], [c.id for c in p.writes])
        return dag

    def print_dag(self) -> None:
        print(self.dag.debug_string())

    def run(self, *targets: Collection) -> "Pipeline":
        """Runs the plans that haven't run yet; with targets, only those that these collections need."""
        dag = self.dag
        wanted = set(dag.before)
        if targets:
            last = [p.id for c in targets for p in self._plans if any(w is c for w in p.writes)]
            wanted = dag.needed(last)
        for level in dag.levels():
            todo = [self._plans[i] for i in level if i in wanted and i not in self._done]
            if self.runner == "wide" and len(todo) > 1:
                with ThreadPoolExecutor(len(todo)) as pool:
                    list(pool.map(self._execute, todo))
            else:
                for plan in todo:
                    self._execute(plan)
        return self

    def _execute(self, plan: Plan) -> None:
        self.spark.sparkContext.setJobDescription(plan.name)
        try:
            plan.execute(plan)
        finally:
            self.spark.sparkContext.setJobDescription(None)
        self._done.add(plan.id)

    def _record(self, name: str, reads: tuple[Collection, ...], writes: tuple[Collection, ...], execute: Callable[[Plan], Any]) -> Plan:
        plan = Plan(len(self._plans), name, reads, writes, execute)
        self._plans.append(plan)
        return plan

    def _loaded(self, name: str, read: Callable[[], DataFrame]) -> Collection:
        c = self.collection(name)
        self._record(name, (), (c,), lambda plan: c.bind(read()))
        return c

    def _update(self, name: str, source: Collection, side: Collection | None, target: Collection, mapper: Mapper, update: Mapping[str, Fold] | PythonFold, broadcast_rows: int | None = None) -> Plan:
        if not target.key:
            raise ValueError(f"{target.name} has no key")

        def fold(state: DataFrame | None) -> DataFrame:
            inputs = [state if c is target and state is not None else c.frame() for c in (source, side) if c is not None]
            if side is not None and side is not target and broadcast_rows is not None and inputs[1].limit(broadcast_rows + 1).count() <= broadcast_rows:
                inputs[1] = F.broadcast(inputs[1])
            schema = target.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") if target.schema is not None and isinstance(update, PythonFold) else None
            out = fold_messages(mapper(*inputs), state, target.key, update, target.defaults, target.dense, schema)
            if state is None and target.schema is not None:
                kinds = {f.name: f.dataType for f in target.schema.fields}
                out = out.select(*(F.col(k).cast(kinds[k]).alias(k) if k in out.columns else F.lit(target.defaults.get(k)).cast(kinds[k]).alias(k) for k in kinds))
            return out

        def execute(plan: Plan) -> None:
            if plan.rounds == 0:
                if target.df is None:
                    target.bind(self.spark.createDataFrame([], target.schema), 0)
                return
            state, rounds = target.df, plan.rounds
            if state is None:
                state, rounds = fold(None), rounds - 1
            every = plan.checkpoint_every or 5
            target.bind(loops.iterate(state, lambda df, n: fold(df), rounds, plan.until, every, plan.checkpoint_path, plan.staleness), plan.rounds)

        reads = tuple(c for c in (source, side) if c is not None)
        return self._record(name, reads, (target,), execute)


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

