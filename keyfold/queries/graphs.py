"""Ranks, distances, closures and matches over the graph of parts that follow each other in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.operators import crawl, graph, matching
from keyfold.sources.tables import order_edges, part_labels, table

SOURCE = 1


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("vertex", F.round("pr", 6).alias("pr"))


def adjacency_build(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency_of(order_edges(spark, sf)).select("vertex", "degree", F.concat_ws(" ", F.transform("outlinks", lambda x: x.cast("string"))).alias("outlinks"))


def pagerank_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(graph.pagerank_cumulative(order_edges(spark, sf), 5))


def pagerank_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(graph.pagerank_delta(order_edges(spark, sf), 6))


def pagerank_bsp(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(graph.pagerank_bsp(order_edges(spark, sf), 6))


def pagerank_with_links(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(graph.pagerank_with_links(graph.adjacency_of(order_edges(spark, sf)), rounds=7))


def pagerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(graph.top_ranks(graph.pagerank_bsp(order_edges(spark, sf), 6)))


def pagerank_compare(spark: SparkSession, sf: str) -> DataFrame:
    edges = storage.cut(order_edges(spark, sf))
    named = lambda df: df.select(F.col("vertex").alias("id"), F.col("pr").alias("value"))
    return graph.compare(named(graph.pagerank_bsp(edges, 4)), named(graph.pagerank_delta(edges, 4))).select(F.round("l1", 2).alias("l1"))


def pagerank_sum(spark: SparkSession, sf: str) -> DataFrame:
    return graph.total(graph.pagerank_bsp(order_edges(spark, sf), 6), "pr").select(F.round("total", 4).alias("total"))


def sssp_hops(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shortest_hops(order_edges(spark, sf), SOURCE, 100)


def reachable_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The closure over all edges, until a round finds nothing new, of at most 100."""
    seeds = spark.createDataFrame([(i,) for i in (1, 50, 100)], "vertex long")
    return graph.closure(order_edges(spark, sf), seeds)


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.links_of(table(spark, sf, "pages")).groupBy("src").agg(F.count(F.lit(1)).alias("n_links"), F.min("dst").alias("first_link"))


def pattern_match_count(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_count(matching.labelled(order_edges(spark, sf), part_labels(spark, sf)))


def pattern_match_sibling_count(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_count(matching.labelled(order_edges(spark, sf), part_labels(spark, sf)), sibling=True)


QUERIES = {
    f.__name__: f
    for f in (
        adjacency_build, pagerank_cumulative, pagerank_delta, pagerank_bsp, pagerank_with_links, pagerank_topk, pagerank_compare, pagerank_sum, sssp_hops,
        reachable_closure, page_links, pattern_match_count, pattern_match_sibling_count,
    )
}

_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL),
v AS (SELECT src AS vertex FROM e UNION SELECT dst FROM e), g AS (SELECT src, count(*) AS d FROM e GROUP BY src)"""


def _unrolled(rounds: int, first: str, following: str, last: str, prefix: str = "s") -> str:
    """Rounds as CTEs. following: columns from state columns s.* and r, what a vertex receives of column `sent`."""
    parts = [f"{prefix}0 AS MATERIALIZED (SELECT vertex, {first} FROM v)"]
    for n in range(1, rounds + 1):
        parts.append(
            f"{prefix}{n} AS MATERIALIZED (SELECT s.vertex, {following} FROM {prefix}{n - 1} s LEFT JOIN "
            f"(SELECT e.dst AS vertex, sum(s.sent / g.d) AS r FROM {prefix}{n - 1} s JOIN e ON e.src = s.vertex JOIN g ON g.src = e.src GROUP BY e.dst) m ON m.vertex = s.vertex)"
        )
    return ", ".join(parts) + (f" SELECT vertex, {last} FROM {prefix}{rounds}" if last else "")


_CUMULATIVE = "s.pr + 0.85 * coalesce(r, 0) AS pr, s.pr + 0.85 * coalesce(r, 0) AS sent"
_DELTA = "s.pr + s.sent AS pr, 0.85 * coalesce(r, 0) AS sent"
_BSP = "0.85 * coalesce(r, 0) + 0.15 AS sent"
_PATTERN = f"""
WITH {_EDGES}, p AS (SELECT p_partkey AS id, substr('abcd', p_size % 4 + 1, 1) AS label FROM part),
l AS (SELECT src, a.label AS sl, dst, b.label AS dl FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst)
SELECT count(*) AS matches FROM l ab, l ac, l cb, l cb2, l bd
WHERE ab.sl = 'a' AND ab.dl = 'b' AND ac.src = ab.src AND ac.dl = 'c' AND cb.src = ac.dst AND cb.dst = ab.dst
  AND cb2.src = ac.dst AND cb2.dl = 'b' AND cb2.dst <> ab.dst AND bd.src = cb2.dst AND bd.dl = 'd'"""

ORACLE_SQL = {
    "adjacency_build": f"WITH {_EDGES} SELECT vertex, count(dst) AS degree, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS outlinks FROM v LEFT JOIN e ON e.src = vertex GROUP BY vertex",
    "pagerank_cumulative": f"WITH {_EDGES}, " + _unrolled(5, "0.15::DOUBLE AS pr, 0.15::DOUBLE AS sent", _CUMULATIVE, "round(pr, 6) AS pr"),
    "pagerank_with_links": f"WITH {_EDGES}, " + _unrolled(7, "0.15::DOUBLE AS pr, 0.15::DOUBLE AS sent", _CUMULATIVE, "round(pr, 6) AS pr"),
    "pagerank_delta": f"WITH {_EDGES}, " + _unrolled(6, "0::DOUBLE AS pr, 0.15::DOUBLE AS sent", _DELTA, "round(pr, 6) AS pr"),
    "pagerank_bsp": f"WITH {_EDGES}, " + _unrolled(6, "1::DOUBLE AS sent", _BSP, "round(sent, 6) AS pr"),
    "pagerank_topk": f"WITH {_EDGES}, " + _unrolled(6, "1::DOUBLE AS sent", _BSP, "round(sent, 6) AS pr") + " ORDER BY sent DESC, vertex LIMIT 10",
    "pagerank_sum": f"WITH {_EDGES}, " + _unrolled(6, "1::DOUBLE AS sent", _BSP, "").rstrip() + " SELECT round(sum(sent), 4) AS total FROM s6",
    "pagerank_compare": f"WITH {_EDGES}, " + _unrolled(4, "1::DOUBLE AS sent", _BSP, "", "b") + ", " + _unrolled(4, "0::DOUBLE AS pr, 0.15::DOUBLE AS sent", _DELTA, "", "d")
    + " SELECT round(sum(abs(coalesce(b4.sent, 0) - coalesce(d4.pr, 0))), 2) AS l1 FROM b4 FULL JOIN d4 USING (vertex)",
    "sssp_hops": f"""
WITH RECURSIVE {_EDGES}, w AS (SELECT {SOURCE}::BIGINT AS vertex, 0 AS dist UNION SELECT e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.vertex WHERE w.dist < 12)
SELECT v.vertex, min(w.dist)::INT AS dist FROM v LEFT JOIN w USING (vertex) GROUP BY v.vertex""",
    "reachable_closure": f"""
WITH RECURSIVE {_EDGES}, w AS (SELECT unnest([1, 50, 100])::BIGINT AS vertex UNION SELECT e.dst FROM w JOIN e ON e.src = w.vertex)
SELECT vertex, 'Done' AS status FROM w""",
    "page_links": r"""
WITH h AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS site, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1) AS folder,
  unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"''#]+)', 1)) AS h FROM pages),
l AS (SELECT DISTINCT url AS src, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN regexp_extract(site, '^([^:]+:)', 1) || h
  WHEN h LIKE '/%' THEN site || h ELSE CASE WHEN folder <> '' THEN folder ELSE site || '/' END || h END AS dst FROM h)
SELECT src, count(*) AS n_links, min(dst) AS first_link FROM l GROUP BY src""",
    "pattern_match_count": _PATTERN,
    "pattern_match_sibling_count": _PATTERN + "\n  AND EXISTS (SELECT 1 FROM l x JOIN l y ON y.dst = x.dst WHERE x.src = ab.src AND x.dl = 'c' AND y.src = ab.dst AND y.sl = 'b' AND y.dl = 'c')",
}
