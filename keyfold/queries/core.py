"""The primitive, its modifiers, joins, partitionings, set operations and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.operators import map_update as mu
from keyfold.operators import partitioning
from keyfold.operators.folds import Append, Count, Ignore, Max, Min, Overwrite, SetAdd, Sum, TopK, VectorSum
from keyfold.operators.iterate import repeated
from keyfold.plans import Pipeline
from keyfold.sources.tables import table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def sum_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Through the pipeline: map each line to its part's quantity, fold by sum into an empty collection."""
    p = Pipeline(spark)
    lines = p.collection("lines", _lines(spark, sf).select("l_partkey", "l_quantity"))
    parts = p.placeholder("part long, qty double", ["part"], defaults={"qty": 0.0}, name="parts")
    p.map_update(lines, parts, lambda df: df.select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("msg")), {"qty": Sum()}).set_combine("shuffle")
    return p.run().collections[1].frame()


def iter_recount(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines folded in for several rounds count as often."""
    emit = lambda df: df.select(F.col("l_returnflag").alias("flag"), F.lit(1).alias("msg"))
    return repeated(None, lambda state: mu.map_update(_lines(spark, sf), state, ("flag",), emit, {"cnt": Sum()}, {"cnt": 0}), 3).select("flag", F.col("cnt").cast("long").alias("cnt"))


def folds_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Count, sum, min and max side by side: a tuple of folds."""
    emit = lambda df: df.select(F.col("l_suppkey").alias("supp"), "l_quantity", "l_linenumber")
    folds = {"n": Count(), "qty": Sum("l_quantity"), "low": Min("l_quantity"), "high": Max("l_linenumber")}
    return mu.map_update(_lines(spark, sf), None, ("supp",), emit, folds)


def list_append(spark: SparkSession, sf: str) -> DataFrame:
    emit = lambda df: df.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("msg"))
    out = mu.map_update(table(spark, sf, "orders"), None, ("cust",), emit, {"orders": Append()})
    return out.select("cust", F.concat_ws(",", F.transform("orders", lambda x: x.cast("string"))).alias("orders"))


def set_insert(spark: SparkSession, sf: str) -> DataFrame:
    emit = lambda df: df.select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("msg"))
    out = mu.map_update(table(spark, sf, "orders"), None, ("cust",), emit, {"kinds": SetAdd()})
    return out.select("cust", F.concat_ws(",", "kinds").alias("kinds"))


def topk_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The three dearest orders of each customer."""
    emit = lambda df: df.select(F.col("o_custkey").alias("cust"), F.struct("o_totalprice", "o_orderkey").alias("msg"))
    out = mu.map_update(table(spark, sf, "orders"), None, ("cust",), emit, {"best": TopK(k=3)})
    return out.select("cust", F.concat_ws(",", F.transform("best", lambda x: x["o_orderkey"].cast("string"))).alias("orders"))


def vector_sum(spark: SparkSession, sf: str) -> DataFrame:
    emit = lambda df: df.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("msg"))
    out = mu.map_update(table(spark, sf, "embeddings"), None, ("label",), emit, {"total": VectorSum(size=64)})
    return out.select("label", F.posexplode("total").alias("i", "x")).select("label", "i", F.round("x", 4).alias("x"))


def overwrite_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event."""
    emit = lambda df: df.select("user_id", F.col("event_type").alias("msg"), F.struct("ts", "event_id").alias("at"))
    return mu.map_update(table(spark, sf, "events"), None, ("user_id",), emit, {"last_type": Overwrite(order="at")})


def distribute_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Driver data dealt out, and its elements by partition."""
    p = Pipeline(spark)
    c = p.distribute(range(1000), "x long", 7, "numbers")
    p.run()
    return c.frame().groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def range_partition_sum(spark: SparkSession, sf: str) -> DataFrame:
    """A dense collection of all keys, updated, and its sums by range."""
    p = Pipeline(spark)
    n = 200
    dense = p.range_placeholder(n, "key long, qty double", defaults={"qty": 0.0}, partitioning=partitioning.ranges([(0, 60), (60, 120), (120, 180), (180, 200)]))
    lines = p.collection("lines", _lines(spark, sf).select("l_partkey", "l_quantity"))
    p.map_update(lines, dense, lambda df: df.select(F.pmod("l_partkey", F.lit(n)).alias("key"), F.col("l_quantity").alias("msg")), {"qty": Sum()})
    p.run()
    return dense.placed().groupBy(dense.partitioning.column(("key",)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


def round_robin_partition_sum(spark: SparkSession, sf: str) -> DataFrame:
    scheme = partitioning.round_robin(5)
    return scheme.apply(table(spark, sf, "orders"), ("o_orderkey",)).groupBy(scheme.column(("o_orderkey",)).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def parameter_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Dense keys as rows of 100 neighbouring values."""
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return partitioning.blocks(prices, "k", "p_size", 100).select("block", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def update_existing_only(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' balances with their orders' prices; each order's customer must be known."""
    state = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("bal"))
    emit = lambda df: df.select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("msg"))
    return mu.map_update(table(spark, sf, "orders"), state, ("cust",), emit, {"bal": Sum()}, existing_only=True).select("cust", F.round("bal", 2).alias("bal"))


def full_outer_update(spark: SparkSession, sf: str) -> DataFrame:
    """Two inputs that update different columns of one collection, to which either may add keys."""
    p = Pipeline(spark, "wide")
    both = p.placeholder("id long, bought double, viewed long", ["id"], defaults={"bought": 0.0, "viewed": 0}, name="both")
    orders = p.collection("orders", table(spark, sf, "orders").select("o_custkey", "o_totalprice"))
    events = p.collection("events", table(spark, sf, "events").select("user_id"))
    p.map_update(orders, both, lambda df: df.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("msg")), {"bought": Sum()})
    p.map_update(events, both, lambda df: df.select((F.col("user_id") + 1000).alias("id")), {"viewed": Count()})
    p.run()
    return both.frame().select("id", F.round("bought", 2).alias("bought"), "viewed")


def key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = _lines(spark, sf).select((F.col("l_partkey") * 2).alias("p_partkey"))
    return mu.lookup(keys, table(spark, sf, "part").select("p_partkey", "p_size"), ("p_partkey",), {"p_size": 0})


def side_join_update(spark: SparkSession, sf: str) -> DataFrame:
    """Lines mapped with their part's brand, read from a side collection that is broadcast if it is small."""
    mapper = lambda a, b: a.join(b, a["l_partkey"] == b["p_partkey"]).select(F.col("p_brand").alias("brand"), F.col("l_quantity").alias("msg"))
    return mu.map_with_update(_lines(spark, sf), table(spark, sf, "part").select("p_partkey", "p_brand"), None, ("brand",), mapper, {"qty": Sum()}, broadcast_rows=100_000)


def sort_each_partition_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A collection sorted within its partitions, and the first key of each."""
    p = Pipeline(spark)
    c = p.collection("parts", table(spark, sf, "part").select("p_partkey"), ["p_partkey"], partitioning=partitioning.round_robin(4))
    p.sort_each_partition(c)
    p.run()
    number = partitioning.round_robin(4).column(("p_partkey",)).cast("int")
    return c.frame().groupBy(number.alias("part")).agg(F.first("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


def union_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Several inputs, one target."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    state = mu.fold_messages(a, None, ("nation",), {"n": Count()}, {"n": 0})
    return mu.fold_messages(b, state, ("nation",), {"n": Count()}, {"n": 0}).select("nation", F.col("n").cast("long").alias("n"))


def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return mu.map_update(_lines(spark, sf), None, ("key",), lambda df: df.select(F.col("l_suppkey").alias("key")), {"_": Ignore()}).select("key")


def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every 40th point, and the 20 with the smallest digests."""
    points = table(spark, sf, "embeddings").select("vec_id", "label")
    every = points.filter("vec_id % 40 = 0").select("vec_id", "label", F.lit("every").alias("how"))
    least = points.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(20).select("vec_id", "label", F.lit("digest").alias("how"))
    return every.union(least)


def checkpoint_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{storage.checkpoint_dir(spark)}/keyfold-roundtrip-{abs(hash(sf)) % 10**8}"
    p = Pipeline(spark)
    c = p.collection("nations", table(spark, sf, "nation"), ["n_nationkey"])
    p.checkpoint(c, path)
    p.load_checkpoint(c)
    p.run()
    return c.frame()


def element_count(spark: SparkSession, sf: str) -> DataFrame:
    p = Pipeline(spark)
    n = p.count(p.collection("events", table(spark, sf, "events")))
    p.run()
    return spark.createDataFrame([(n.result,)], "n long")


QUERIES = {
    f.__name__: f
    for f in (
        sum_by_key, iter_recount, folds_by_key, list_append, set_insert, topk_by_key, vector_sum, overwrite_latest, distribute_round_robin, range_partition_sum,
        round_robin_partition_sum, parameter_blocks, update_existing_only, full_outer_update, key_lookup, side_join_update, sort_each_partition_rank, union_updates,
        distinct_keys, deterministic_sample, checkpoint_roundtrip, element_count,
    )
}

ORACLE_SQL = {
    "sum_by_key": "SELECT l_partkey AS part, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey",
    "iter_recount": "SELECT l_returnflag AS flag, 3 * count(*) AS cnt FROM lineitem GROUP BY l_returnflag",
    "folds_by_key": "SELECT l_suppkey AS supp, count(*) AS n, sum(l_quantity) AS qty, min(l_quantity) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_suppkey",
    "list_append": "SELECT o_custkey AS cust, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "set_insert": "SELECT o_custkey AS cust, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT DISTINCT o_custkey, o_orderpriority AS k FROM orders) GROUP BY o_custkey",
    "topk_by_key": "SELECT o_custkey AS cust, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey DESC) AS orders FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3) GROUP BY o_custkey",
    "vector_sum": "SELECT label, (i - 1)::INT AS i, round(sum(embedding[i]::DOUBLE), 4) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i",
    "overwrite_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id",
    "distribute_round_robin": "SELECT (x % 7)::INT AS part, count(*) AS n, sum(x)::BIGINT AS total FROM (SELECT unnest(range(1000)) AS x) GROUP BY 1",
    "range_partition_sum": "WITH k AS (SELECT unnest(range(200)) AS key), q AS (SELECT l_partkey % 200 AS key, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) SELECT least(3, key // 60)::INT AS part, count(*) AS n, sum(coalesce(qty, 0)) AS qty FROM k LEFT JOIN q USING (key) GROUP BY 1",
    "round_robin_partition_sum": "SELECT (o_orderkey % 5)::INT AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "parameter_blocks": "SELECT p_partkey // 100 AS block, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1",
    "update_existing_only": "SELECT c_custkey AS cust, round(c_acctbal + coalesce(t, 0), 2) AS bal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "full_outer_update": "SELECT id, round(coalesce(t, 0), 2) AS bought, coalesce(n, 0) AS viewed FROM (SELECT o_custkey AS id, sum(o_totalprice) AS t FROM orders GROUP BY 1) FULL JOIN (SELECT user_id + 1000 AS id, count(*) AS n FROM events GROUP BY 1) USING (id)",
    "key_lookup": "SELECT k AS p_partkey, coalesce(p_size, 0) AS p_size FROM (SELECT DISTINCT l_partkey * 2 AS k FROM lineitem) LEFT JOIN part ON p_partkey = k",
    "side_join_update": "SELECT p_brand AS brand, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "sort_each_partition_rank": "SELECT (p_partkey % 4)::INT AS part, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY 1",
    "union_updates": "SELECT k AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "distinct_keys": "SELECT DISTINCT l_suppkey AS key FROM lineitem",
    "deterministic_sample": "SELECT vec_id, label, 'every' AS how FROM embeddings WHERE vec_id % 40 = 0 UNION ALL (SELECT vec_id, label, 'digest' FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 20)",
    "checkpoint_roundtrip": "SELECT * FROM nation",
    "element_count": "SELECT count(*) AS n FROM events",
}
