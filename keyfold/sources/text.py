"""Text files: lines, whole files, records, the record grammars of the applications, and the text sink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import tokens

BLANK = r"[ \t]+"


def lines(spark: SparkSession, path: str, max_per_file: int | None = None) -> DataFrame:
    """A row (value) per line. max_per_file: only so many first lines of each file; 0 or None: all."""
    if not max_per_file:
        return spark.read.text(path)
    # whole files are read in order, so the cut is the same every time
    whole = spark.read.text(path, wholetext=True).select(F.slice(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"), 1, max_per_file).alias("v"))
    return whole.select(F.explode("v").alias("value"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder, not of folders in it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")


def lazy_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the path and the block of the file that they are in."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("offset"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """A row (path, value) per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records (path, number, value) of files whose records each end with a line `</doc>`; see split_records."""
    return whole_files(spark, path).select("path", F.posexplode(split_records(F.col("value"))).alias("number", "value"))


def split_records(whole: Column) -> Column:
    """Records of a text: those ended by a line `</doc>`. Lines are joined with a blank before each; what comes after
    the last end is left out."""
    marked = F.split(F.concat(F.lit("\n"), whole, F.lit("\n")), "\n</doc>(?=\n)")
    complete = F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0)))
    return F.transform(complete, lambda r: F.regexp_replace(r, "\n", " "))


def adjacency(rows: DataFrame, value: str = "value") -> DataFrame:
    """`id degree neighbour ...` as (vertex, outlinks); the degree is passed over."""
    t = tokens(F.col(value), BLANK)
    return rows.select(t.alias("t")).filter(F.size("t") > 0).select(F.col("t")[0].cast("long").alias("vertex"), F.transform(F.slice("t", 3, F.greatest(F.size("t"), F.lit(1))), lambda x: x.cast("long")).alias("outlinks"))


def labelled_adjacency(rows: DataFrame, value: str = "value") -> DataFrame:
    """`id label (neighbour label)*` as (id, label, outlinks of (id, label)); a label is its first character."""
    t = rows.select(tokens(F.col(value), BLANK).alias("t")).filter(F.size("t") > 1)
    n = F.floor((F.size("t") - 2) / 2).cast("int")
    links = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get("t", 2 * i).cast("long").alias("id"), F.substring(F.get("t", 2 * i + 1), 1, 1).alias("label"))))
    empty = F.array().cast("array<struct<id: bigint, label: string>>")
    return t.select(F.col("t")[0].cast("long").alias("id"), F.substring(F.col("t")[1], 1, 1).alias("label"), F.coalesce(links, empty).alias("outlinks"))


def libsvm(rows: DataFrame, value: str = "value") -> DataFrame:
    """`y index:value ...` as (y, x of (i, v)); indexes from 1 become indexes from 0."""
    t = rows.select(tokens(F.col(value), BLANK).alias("t")).filter(F.size("t") > 0)
    pair = lambda s: F.struct((F.split(s, ":")[0].cast("int") - 1).alias("i"), F.split(s, ":")[1].cast("float").alias("v"))
    return t.select(F.col("t")[0].cast("double").cast("int").alias("y"), F.transform(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), pair).alias("x"))


def ratings(rows: DataFrame, value: str = "value") -> DataFrame:
    """`user item rating`."""
    t = rows.select(tokens(F.col(value), BLANK).alias("t")).filter(F.size("t") >= 3)
    return t.select(F.col("t")[0].cast("int").alias("user"), F.col("t")[1].cast("int").alias("item"), F.col("t")[2].cast("float").alias("rating"))


def titled_documents(rows: DataFrame, value: str = "value") -> DataFrame:
    """Records with a header that has title="..."."""
    return rows.select(F.regexp_extract(value, r'title="(.*?)"', 1).alias("title"), F.regexp_replace(value, r"<doc[^>]*>", " ").alias("text"))


def line_documents(rows: DataFrame, value: str = "value") -> DataFrame:
    """A document a line."""
    return rows.select(F.col(value).alias("text"))


def scores(rows: DataFrame, value: str = "value") -> DataFrame:
    """`id value`."""
    t = rows.select(tokens(F.col(value), BLANK).alias("t")).filter(F.size("t") >= 2)
    return t.select(F.col("t")[0].cast("long").alias("id"), F.col("t")[1].cast("double").alias("value"))


def seeds(text: Column) -> Column:
    """Parts between commas, without empty ones."""
    return tokens(text, ",")


def write_lines(df: DataFrame, path: str, most: int | None = None) -> None:
    """One column of strings, a file per partition. most: several files of at most so many bytes, and of a row at least, for
    those that are read as a whole."""
    if not most:
        df.write.mode("overwrite").text(path)
        return

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as few long ones, with the line ends between them inside: each is a file."""
        held, size = [], 0

        def joined() -> pa.RecordBatch:
            rows = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), "\n")], names=["value"])

        for b in it:
            rows = pc.fill_null(b.column(0).cast(pa.string()), "")
            ends, at = np.concatenate(([0], np.cumsum(pc.binary_length(rows).to_numpy().astype(np.int64) + 1))), 0
            while at < len(rows):
                stop = max(at + (not held), int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1)
                if stop > at:
                    held.append(rows.slice(at, stop - at))
                    size += int(ends[stop] - ends[at])
                if stop < len(rows):
                    yield joined()
                    held, size = [], 0
                at = stop
        if held:
            yield joined()

    df.mapInArrow(packed, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)

