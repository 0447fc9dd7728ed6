"""Beyond the map-and-fold programs: windows, cubes, semi and time joins, set operations, JSON, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.operators import relational
from keyfold.sources.tables import table
from keyfold.streaming import windows


def win_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("drnk"), F.ntile(4).over(w).alias("quarter"))


def win_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "orders").select("o_orderkey", F.round(running, 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.top_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


def rollup_sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))


def cube_sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("gid"))


def distinct_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps")).filter("parts > 10")


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    dear = orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    a = customers.join(dear, "c_custkey", "left_semi").select("c_custkey", F.lit("dear").alias("kind"))
    b = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("kind"))
    return a.unionByName(b)


def asof_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last click or view before it."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    seen = events.filter("event_type in ('click', 'view')").select("user_id", "ts", F.col("event_id").alias("seen_id"))
    return relational.as_of(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", ["seen_id"])


def interval_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the size ranges of regions: an interval join by buckets."""
    ranges = table(spark, sf, "region").select("r_regionkey", (F.col("r_regionkey") * 9).alias("low"), (F.col("r_regionkey") * 9 + 14).alias("high"))
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return relational.interval_join(parts, ranges, "p_size", "low", "high", 10).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("total"))


def intersect_except(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    b = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_custkey")
    return a.intersect(b).withColumn("how", F.lit("both")).unionByName(a.exceptAll(b).withColumn("how", F.lit("more")))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy(k.alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("ts", "user_id", "event_type", "value")


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.tumbling(_events(spark, sf), "ts", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return _naive(out, "window_start", "window_end")


def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(windows.sliding(_events(spark, sf), "ts", "12 hours", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n")]), "window_start", "window_end")


def session(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(windows.session_counts(_events(spark, sf), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]), "session_start", "session_end")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """The tumbling counts again, from a stream over the same file."""
    import uuid

    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = windows.tumbling(rows, "ts", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    return _naive(windows.run_available(out, f"keyfold_{uuid.uuid4().hex}"), "window_start", "window_end")


QUERIES = {
    f.__name__: f
    for f in (
        win_rank, win_running_sum, top_orders, pricing_summary, rollup_sales, cube_sales, distinct_aggregates, semi_anti, asof_events, interval_parts, intersect_except,
        json_props, tumbling, sliding, session, stream_tumbling,
    )
}

ORACLE_SQL = {
    "win_rank": "SELECT c_custkey, row_number() OVER w::INT AS rn, rank() OVER w::INT AS rnk, dense_rank() OVER w::INT AS drnk, ntile(4) OVER w::INT AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "top_orders": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rollup_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_sales": "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 10",
    "semi_anti": "SELECT c_custkey, 'dear' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "asof_events": "SELECT event_id, user_id, ts, (SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.user_id = e.user_id AND s.ts <= e.ts AND s.event_type IN ('click', 'view')) AS seen_id FROM events e WHERE event_type = 'purchase'",
    "interval_parts": "SELECT r_regionkey, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part JOIN region ON p_size >= r_regionkey * 9 AND p_size < r_regionkey * 9 + 14 GROUP BY 1",
    "intersect_except": "(SELECT o_custkey, 'both' AS how FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) UNION ALL (SELECT o_custkey, 'more' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))",
    "json_props": "SELECT (props->>'$.k')::INT AS k, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding": "SELECT b - k * INTERVAL 6 HOURS AS window_start, b - k * INTERVAL 6 HOURS + INTERVAL 12 HOURS AS window_end, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
    "session": """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, g.n""",
    "stream_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
}
