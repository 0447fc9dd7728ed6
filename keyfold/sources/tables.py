"""Column stores and the shapes derived from the engine's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions import hash_bucket


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, text or any other source that the session has."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct edges (src, dst): from each part of an order to the next, by line, part and supplier."""
    step = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(step).alias("dst"))
    return pairs.filter("dst is not null").distinct()


def part_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label): a letter from a to d by the part's size."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.substring(F.lit("abcd"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("label"))


def order_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, rating): a customer's mean quantity of a part."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def initial_factor(key: str, n: int, salt: str) -> list:
    """n deterministic numbers from 0 to 1 of a key, as columns."""
    return [hash_bucket(F.concat(F.lit(f"{salt}{i}:"), F.col(key).cast("string")), 1000) / 1000.0 for i in range(n)]
