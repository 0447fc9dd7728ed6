"""From raw documents to packed sequences: quality rules, exact and near dedup, mixing, packing.

Each stage reads what the one before has written as Parquet. All but the last give rows of documents, with all their
columns; the last gives a row per piece. Tables that a stage writes for itself go when its rows are written.

Defined results, by stage, for rows with a null, empty or repeated id or text: quality drops texts under 20 words, so
null and empty ones, and those of blocked hosts (a null source is a host); exact leaves one row of equal texts, the
longest, then with the least id (a null id last), and any one of rows that repeat that too; near leaves one row of each
component in the same way, and rows without words, if there were any, each for itself; mix repeats whole rows, up to three
times; pack takes a null text for an empty one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import exact_dedup, host_rules, mixing, near_dedup, packing
from keyfold.llm.common import free, freed_but, materialise, table
from keyfold.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_single(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_single(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Packing can't be told in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        written: list[DataFrame] = []
        with freed_but(written):
            written.append(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        free(docs)  # the rows of the stage before
        docs = written[0]
    return STAGES[-1][1](spark, docs, sf_dir)
