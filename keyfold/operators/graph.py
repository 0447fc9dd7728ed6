"""Ranks, distances and closures of graphs given as edges (src, dst). Repeated edges count each.

Edges are computed once and written. Loops keep them partitioned by source and the state partitioned by vertex, so a round
shuffles only messages; what a loop keeps goes when it ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.operators.iterate import iterate

DAMPING = 0.85
START = 0.15


def edges_of(adjacency: DataFrame) -> DataFrame:
    """(vertex, outlinks) as edges."""
    return adjacency.select(F.col("vertex").alias("src"), F.explode("outlinks").alias("dst"))


def adjacency_of(edges: DataFrame) -> DataFrame:
    """(vertex, outlinks, degree): every vertex that is a source or a target, its targets sorted."""
    out = edges.groupBy(F.col("src").alias("vertex")).agg(F.array_sort(F.collect_list("dst")).alias("outlinks"))
    none = F.array().cast("array<bigint>")
    return vertices_of(edges).join(out, "vertex", "left").select("vertex", F.coalesce("outlinks", none).alias("outlinks"), F.coalesce(F.size("outlinks"), F.lit(0)).cast("long").alias("degree"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def _weighted(edges: DataFrame) -> DataFrame:
    """(vertex, dst, degree), by vertex."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return edges.join(degree, "src").select(F.col("src").alias("vertex"), "dst", "degree").repartition("vertex").persist(StorageLevel.MEMORY_AND_DISK)


def _spread(state: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """(vertex, received): what vertices get from those that link to them, each of which divides its value evenly."""
    sent = links.join(state.select("vertex", value), "vertex").select(F.col("dst").alias("vertex"), (F.col(value) / F.col("degree")).alias("m"))
    return sent.groupBy("vertex").agg(F.sum("m").alias("received"))


def _rounds(edges: DataFrame, columns: dict[str, float], next_columns: Callable[[], dict], sent: Callable[[DataFrame], DataFrame], rounds: int, **loop) -> DataFrame:
    edges = storage.cut(edges)
    links = _weighted(edges)
    start = vertices_of(edges).select("vertex", *(F.lit(v).alias(c) for c, v in columns.items()))

    def step(state: DataFrame, n: int) -> DataFrame:
        got = _spread(sent(state), links, "sent")
        return state.join(got, "vertex", "left").withColumn("received", F.coalesce("received", F.lit(0.0))).select("vertex", *(e.alias(c) for c, e in next_columns().items()))

    out = iterate(start, step, rounds, **loop)
    links.unpersist()
    return out


def pagerank_cumulative(edges: DataFrame, rounds: int = 5, **loop) -> DataFrame:
    """pr starts at 0.15 and grows by 0.85 of what a vertex receives."""
    return _rounds(edges, {"pr": START}, lambda: {"pr": F.col("pr") + DAMPING * F.col("received")}, lambda s: s.select("vertex", F.col("pr").alias("sent")), rounds, **loop)


def pagerank_delta(edges: DataFrame, rounds: int = 10, **loop) -> DataFrame:
    """pr gathers deltas; the next delta is 0.85 of what a vertex receives of them. The last delta isn't added."""
    out = _rounds(edges, {"pr": 0.0, "delta": START}, lambda: {"pr": F.col("pr") + F.col("delta"), "delta": DAMPING * F.col("received")}, lambda s: s.select("vertex", F.col("delta").alias("sent")), rounds, **loop)
    return out.select("vertex", "pr")


def pagerank_bsp(edges: DataFrame, rounds: int = 10, snapshot: Callable[[DataFrame, int], None] | None = None, outer: int = 1, **loop) -> DataFrame:
    """Ranks that start at 1 and are 0.15 plus 0.85 of what a vertex receives. snapshot: sees the ranks after each of
    the outer stretches of rounds."""
    edges = storage.cut(edges)
    links = _weighted(edges)
    state = vertices_of(edges).select("vertex", F.lit(DAMPING).alias("x"))

    def step(state: DataFrame, n: int) -> DataFrame:
        got = _spread(state.select("vertex", (F.col("x") + START).alias("sent")), links, "sent")
        return state.join(got, "vertex", "left").select("vertex", (DAMPING * F.coalesce("received", F.lit(0.0))).alias("x"))

    for n in range(outer):
        state = iterate(state, step, rounds, **loop)
        if snapshot:
            snapshot(state.select("vertex", (F.col("x") + START).alias("pr")), n)
    links.unpersist()
    return state.select("vertex", (F.col("x") + START).alias("pr"))


def pagerank_with_links(links: DataFrame, ranks: DataFrame | None = None, rounds: int = 25, checkpoint_every: int = 5, **loop) -> DataFrame:
    """The cumulative recurrence over adjacency rows (vertex, outlinks) that stand beside the ranks and are joined to
    them each round. ranks: those to go on from."""
    links = links.select("vertex", "outlinks").repartition("vertex").persist(StorageLevel.MEMORY_AND_DISK)
    if ranks is None:
        ranks = vertices_of(edges_of(links)).union(links.select("vertex")).distinct().select("vertex", F.lit(START).alias("pr"))

    def step(state: DataFrame, n: int) -> DataFrame:
        sent = links.join(state, "vertex").select(F.explode("outlinks").alias("to"), (F.col("pr") / F.size("outlinks")).alias("m"))
        got = sent.groupBy(F.col("to").alias("vertex")).agg(F.sum("m").alias("received"))
        return state.join(got, "vertex", "left").select("vertex", (F.col("pr") + DAMPING * F.coalesce("received", F.lit(0.0))).alias("pr"))

    out = iterate(ranks, step, rounds, checkpoint_every=checkpoint_every, **loop)
    links.unpersist()
    return out


def top_ranks(ranks: DataFrame, k: int = 10) -> DataFrame:
    """At most k vertices, by rank, then by number."""
    return ranks.orderBy(F.desc("pr"), "vertex").limit(k)


def compare(a: DataFrame, b: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """The sum of absolute differences of two results; what one hasn't got counts as 0 there."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    return both.agg(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("l1"))


def total(ranks: DataFrame, value: str = "value") -> DataFrame:
    return ranks.agg(F.sum(value).alias("total"))


def shortest_hops(edges: DataFrame, source: int, rounds: int, unreached: int | None = None) -> DataFrame:
    """(vertex, dist): the fewest edges from the source, of paths of at most so many; unreached otherwise.

    Each round sends from the vertices found in the round before only, and ends early when there are none.
    """
    edges = storage.cut(edges)
    links = edges.select(F.col("src").alias("vertex"), "dst").distinct().repartition("vertex").persist(StorageLevel.MEMORY_AND_DISK)
    start = vertices_of(edges).select("vertex", F.when(F.col("vertex") == source, 0).cast("int").alias("dist"), (F.col("vertex") == source).alias("updated"))

    def step(state: DataFrame, n: int) -> DataFrame:
        found = links.join(state.filter("updated").select("vertex"), "vertex", "left_semi").select(F.col("dst").alias("vertex")).distinct().withColumn("_found", F.lit(True))
        new = F.col("_found") & F.col("dist").isNull()
        return state.join(found, "vertex", "left").select("vertex", F.when(new, F.lit(n)).otherwise(F.col("dist")).cast("int").alias("dist"), F.coalesce(new, F.lit(False)).alias("updated"))

    out = iterate(start, step, rounds, until=lambda old, new: new.filter("updated").limit(1).count() == 0)
    links.unpersist()
    return out.select("vertex", F.coalesce("dist", F.lit(unreached)).cast("int").alias("dist") if unreached is not None else "dist")


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(vertex, status): what is reachable from the seeds (vertex). Vertices that were expanded are done; those found
    in the last round, if rounds ran out, are still to be."""
    links = edges.select(F.col("src").alias("vertex"), "dst").distinct().repartition("vertex").persist(StorageLevel.MEMORY_AND_DISK)
    start = seeds.select("vertex").distinct().withColumn("done", F.lit(False))

    def step(state: DataFrame, n: int) -> DataFrame:
        found = links.join(state.filter("not done").select("vertex"), "vertex", "left_semi").select(F.col("dst").alias("vertex")).distinct()
        fresh = found.join(state.select("vertex"), "vertex", "left_anti").withColumn("done", F.lit(False))
        return state.withColumn("done", F.lit(True)).unionByName(fresh)

    out = iterate(start, step, rounds, until=lambda old, new: new.filter("not done").limit(1).count() == 0, checkpoint_every=3)
    links.unpersist()
    return out.select("vertex", F.when(F.col("done"), "Done").otherwise("ToFetch").alias("status"))
