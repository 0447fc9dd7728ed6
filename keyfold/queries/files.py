"""Programs over text files: lines, whole files and the record grammars, partition functions, keyed data from the driver, and
what resumes from snapshots. Each query writes its input as text in the checkpoint folder first, and reads that."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.operators import iterate as loops
from keyfold.operators import map_update as mu
from keyfold.operators import partitioning
from keyfold.operators.folds import Count, Sum
from keyfold.plans import Pipeline
from keyfold.sources import text as text_source
from keyfold.sources.tables import order_edges, order_ratings, part_labels, table

#: Bytes of a file that is read as a whole: a row that a task holds, so it doesn't grow with the input.
WHOLE = 8_000_000


def _through_text(spark: SparkSession, rows: DataFrame, read: Callable[[str], DataFrame], most: int | None = None) -> DataFrame:
    """What read makes of rows, a column of lines, once they are written as text. The result is written, the text goes.
    most: bytes of a file, if files are read as a whole."""
    path = f"{storage.checkpoint_dir(spark)}/keyfold-text-{uuid.uuid4().hex}"
    text_source.write_lines(rows, path, most)
    out = storage.cut(read(path))
    storage.remove(spark, path)
    return out


def _line(*columns: Column | str) -> Column:
    return F.concat_ws(" ", *(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in columns)).alias("value")


def load_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and quantities as lines, loaded and folded by key through the pipeline."""
    lines = table(spark, sf, "lineitem").select(_line("l_partkey", F.col("l_quantity").cast("int")))

    def read(path: str) -> DataFrame:
        p = Pipeline(spark)
        loaded = p.load(path, lambda df: df.select(F.split("value", " ").alias("t")))
        sums = p.placeholder("part long, qty long", ["part"], defaults={"qty": 0}, name="sums")
        p.map_update(loaded, sums, lambda df: df.select(F.col("t")[0].cast("long").alias("part"), F.col("t")[1].cast("long").alias("msg")), {"qty": Sum()})
        p.run(sums)
        return sums.frame()

    return _through_text(spark, lines, read)


def lazy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are read where a plan needs them, and the files that they are in."""

    def read(path: str) -> DataFrame:
        p = Pipeline(spark)
        loaded = p.load_block_meta(path)
        p.run()
        return loaded.frame().agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"), (F.count_distinct("path") > 0).alias("has_files"))

    return _through_text(spark, table(spark, sf, "orders").select(_line("o_orderkey", "o_orderstatus", "o_orderpriority")), read)


def whole_file_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records of whole files, ended by lines `</doc>`, with their titles."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit('<doc title="'), F.col("doc_id").cast("string"), F.lit('">\n'), F.col("text"), F.lit("\n</doc>")).alias("value"))

    def read(path: str) -> DataFrame:
        p = Pipeline(spark)
        loaded = p.load_wholefiles(path, lambda df: text_source.titled_documents(df))
        p.run()
        return loaded.frame().select(F.col("title").cast("long").alias("doc_id"), F.length(F.trim("text")).cast("long").alias("n_chars"))

    return _through_text(spark, rows, read, WHOLE)


def lazy_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files, read where a plan needs them: the lines of all."""

    def read(path: str) -> DataFrame:
        p = Pipeline(spark)
        loaded = p.load_wholefiles_meta(path)
        p.run()
        return loaded.frame().agg(F.sum(F.size(F.split("value", "\n")) - 1).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))

    return _through_text(spark, table(spark, sf, "customer").select(_line("c_custkey", "c_mktsegment")), read, WHOLE)


def adjacency_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The graph as lines `id degree neighbour ...`, and its out-degrees from them."""
    links = order_edges(spark, sf).groupBy("src").agg(F.collect_list(F.col("dst").cast("string")).alias("to"))
    rows = links.select(_line("src", F.size("to"), F.concat_ws(" ", "to")))
    return _through_text(spark, rows, lambda path: text_source.adjacency(text_source.lines(spark, path)).select("vertex", F.size("outlinks").cast("long").alias("degree"), F.array_max("outlinks").alias("last")))


def labelled_adjacency_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled graph as lines `id label (neighbour label)*`, and how many neighbours of each label there are."""
    labels = part_labels(spark, sf)
    to = order_edges(spark, sf).join(labels.select(F.col("id").alias("dst"), F.col("label").alias("l")), "dst").groupBy("src").agg(F.collect_list(F.concat_ws(" ", F.col("dst").cast("string"), "l")).alias("to"))
    rows = to.join(labels, to["src"] == labels["id"]).select(_line("src", "label", F.concat_ws(" ", "to")))

    def read(path: str) -> DataFrame:
        found = text_source.labelled_adjacency(text_source.lines(spark, path))
        return found.select("label", F.explode("outlinks").alias("o")).groupBy("label", F.col("o.label").alias("to_label")).agg(F.count(F.lit(1)).alias("n"))

    return _through_text(spark, rows, read)


def libsvm_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as sparse points, and the sums of their features."""
    lines = table(spark, sf, "lineitem")
    pairs = F.concat_ws(" ", F.concat(F.lit("1:"), F.col("l_quantity").cast("int").cast("string")), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("3:"), F.col("l_linenumber").cast("string"))))
    rows = lines.select(_line(F.when(F.col("l_returnflag") == "R", 1).otherwise(-1), pairs))

    def read(path: str) -> DataFrame:
        points = text_source.libsvm(text_source.lines(spark, path))
        return points.select("y", F.explode("x").alias("x")).groupBy("y", F.col("x.i").alias("fea")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.v").cast("double")).alias("total"))

    return _through_text(spark, rows, read)


def rating_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings as lines `user item rating`, and each user's number and highest one."""
    rows = order_ratings(spark, sf).select(_line("user", "item", F.floor("rating")))
    return _through_text(spark, rows, lambda path: text_source.ratings(text_source.lines(spark, path)).groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("rating").cast("double")).alias("best")))


def line_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document a line: line breaks become blanks before."""
    rows = table(spark, sf, "documents").select(F.translate("text", "\n\r", "  ").alias("value"))
    return _through_text(spark, rows, lambda path: text_source.line_documents(text_source.lines(spark, path)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")))


def score_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines `id value`."""
    rows = table(spark, sf, "customer").select(_line("c_custkey", "c_acctbal"))
    return _through_text(spark, rows, lambda path: text_source.scores(text_source.lines(spark, path)))


def last_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Data of the driver by key: of several elements with a key, the last one stays."""
    rows = [(r["n_regionkey"], r["n_nationkey"]) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    p = Pipeline(spark)
    c = p.distribute_by_key(rows, "region int, nation int", ["region"], 2)
    p.run()
    return c.frame()


def custom_partition_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers dealt by a function of their own key: by the tens digit."""
    by = partitioning.custom(10, lambda key: F.floor(key / 10) % 10)
    suppliers = table(spark, sf, "supplier")
    dealt = by.apply(suppliers, ("s_suppkey",)).withColumn("part", by.column(("s_suppkey",)))
    return dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"))


def partition_map_count(spark: SparkSession, sf: str) -> DataFrame:
    """A mapper that sees a whole partition's batches and emits one message per key and batch."""

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            n = rows.groupby("event_type").size()
            yield pd.DataFrame({"event_type": n.index, "msg": n.to_numpy()})

    events = table(spark, sf, "events").select("event_type")
    return mu.map_update(events, None, ("event_type",), mu.partition_map(partial, "event_type string, msg long"), {"n": Sum()})


def checkpointed_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds with a snapshot each second one, then resumed from the last, to ten in all: counts grow by one a round."""
    path = f"{storage.checkpoint_dir(spark)}/keyfold-rounds-{uuid.uuid4().hex}"
    start = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("n"))
    emit = lambda df: df.select("id")
    step = lambda df, n: mu.map_update(start, df, ("id",), emit, {"n": Count()})
    loops.iterate(start, step, 5, checkpoint_every=2, checkpoint_path=path)
    out = storage.cut(loops.resume(spark, step, 10, 2, path, lambda: start))
    storage.remove(spark, path)
    return out


def paired_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions of two collections that meet by their number: each customer's block with the block of orders."""

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "customers": [len(left)], "orders": [len(right)], "paired": [int(right["cust"].isin(set(left["cust"])).sum())]})

    block = lambda c: F.pmod(F.col(c), F.lit(16)).cast("int").alias("part")
    a = table(spark, sf, "customer").select(block("c_custkey"), F.col("c_custkey").alias("cust"))
    b = table(spark, sf, "orders").select(block("o_custkey"), F.col("o_custkey").alias("cust"))
    return a.groupBy("part").cogroup(b.groupBy("part")).applyInPandas(meet, "part int, customers long, orders long, paired long")


QUERIES = {
    f.__name__: f
    for f in (
        load_lines, lazy_lines, whole_file_records, lazy_files, adjacency_lines, labelled_adjacency_lines, libsvm_lines, rating_lines, line_documents, score_lines,
        last_by_key, custom_partition_sum, partition_map_count, checkpointed_rounds, paired_partitions,
    )
}

_EDGES = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"

ORACLE_SQL = {
    "load_lines": "SELECT l_partkey AS part, sum(l_quantity::INT)::BIGINT AS qty FROM lineitem GROUP BY l_partkey",
    "lazy_lines": "SELECT count(*) AS n_lines, sum(length(o_orderkey::VARCHAR || ' ' || o_orderstatus || ' ' || o_orderpriority))::BIGINT AS n_chars, true AS has_files FROM orders",
    "whole_file_records": "SELECT doc_id, length(trim(replace(text, chr(10), ' '), ' '))::BIGINT AS n_chars FROM documents",
    "lazy_files": "SELECT count(*) AS n_lines, sum(length(c_custkey::VARCHAR || ' ' || c_mktsegment) + 1)::BIGINT AS n_chars FROM customer",
    "adjacency_lines": f"WITH {_EDGES} SELECT src AS vertex, count(*) AS degree, max(dst) AS last FROM e GROUP BY src",
    "labelled_adjacency_lines": f"WITH {_EDGES}, p AS (SELECT p_partkey AS id, substr('abcd', p_size % 4 + 1, 1) AS label FROM part) SELECT a.label, b.label AS to_label, count(*) AS n FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst GROUP BY ALL",
    "libsvm_lines": "WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y, l_quantity::INT AS q, l_linenumber AS k FROM lineitem) SELECT y, 0 AS fea, count(*) AS n, sum(q)::DOUBLE AS total FROM p GROUP BY y UNION ALL SELECT y, 2, count(*), sum(k)::DOUBLE FROM p WHERE k > 1 GROUP BY y",
    "rating_lines": 'WITH r AS (SELECT o_custkey AS "user", l_partkey AS item, floor(avg(l_quantity)) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT "user"::INT AS "user", count(*) AS n, max(rating)::DOUBLE AS best FROM r GROUP BY "user"',
    "line_documents": "SELECT count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents",
    "score_lines": "SELECT c_custkey AS id, c_acctbal AS value FROM customer",
    "last_by_key": "SELECT n_regionkey AS region, max(n_nationkey) AS nation FROM nation GROUP BY n_regionkey",
    "custom_partition_sum": "SELECT s_suppkey // 10 % 10 AS part, count(*) AS n, sum(s_suppkey)::BIGINT AS total FROM supplier GROUP BY 1",
    "partition_map_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "checkpointed_rounds": "SELECT c_custkey AS id, 10::BIGINT AS n FROM customer",
    "paired_partitions": """
WITH c AS (SELECT c_custkey % 16 AS part, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT o_custkey % 16 AS part, count(*) AS n, count(c_custkey) AS paired FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT part::INT AS part, coalesce(c.n, 0) AS customers, coalesce(o.n, 0) AS orders, coalesce(paired, 0) AS paired FROM c FULL JOIN o USING (part)""",
}
