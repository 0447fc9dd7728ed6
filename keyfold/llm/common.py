"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the blank and the five control characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Rows and bytes (as JSON) of a table that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z to lower case, all other bytes as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on a local master, as in tests, one of the machine's own if it is unset."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that executors share")
            where = tempfile.mkdtemp(prefix="keyfold-")
        sc.setCheckpointDir(where)
    return where


#: Tables that materialise has written and nothing has freed yet, in order: session and path.
_written: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # freed before, or the session has ended, and its folder with it
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        _remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks after the last such table. Who writes a table
    frees it once nothing reads it any more (free, freed_but); those that a returned DataFrame reads go when the
    driver's process ends, or with the stage of the pipeline that they belong to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyfold-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyfold_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables of materialise that nothing reads any more."""
    for df in tables:
        if getattr(df, "_keyfold_path", None) in _written:
            _remove(df._keyfold_path)


@contextmanager
def freed_but(keep: list[DataFrame]) -> Iterator[None]:
    """Of the tables written inside, all but those put into keep are deleted at the end."""
    before = set(_written)
    yield
    kept = {getattr(df, "_keyfold_path", None) for df in keep}
    for path in [p for p in _written if p not in before and p not in kept]:
        _remove(path)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has no more than so many rows and, written as JSON, bytes. Reads no more than rows + 1 of it."""
    length = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns))))
    n, held = table.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return n <= rows and held <= size


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised table, broadcast only if its rows and bytes are few.

    Beyond that the join is left to the planner, whose adaptive execution splits hot keys.
    """
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def one_of_each(rows: DataFrame, key: str, repeats: DataFrame, order: Column) -> DataFrame:
    """The fields of rows (_row, key), with one row, the last by order, of each key that repeats names.

    Only then rows are written, and each task leaves one row of a key before these are shuffled, so that a hot key isn't
    read by one task.
    """
    if not repeats.limit(1).count():
        return rows.select("_row.*")
    marked = rows.select(key, "_row", order.alias("_order")).join(repeats.select(key).distinct().withColumn("_again", F.lit(True)), key, "left")
    marked = materialise(marked, "repeated")
    one = marked.filter("_again").groupBy(key).agg(F.max_by("_row", "_order").alias("_row"))
    return marked.filter("_again is null").select("_row.*").union(one.select("_row.*"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def batches(it: Iterable[pa.RecordBatch], rows: int, size: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many rows and, but for single long rows, so many bytes of a column."""
    for b in it:
        start, held = 0, 0
        lengths = pc.binary_length(b.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and (held + n > size or i - start >= rows):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
