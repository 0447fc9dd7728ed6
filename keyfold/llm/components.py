"""Connected components of links, by alternating large and small stars.

In each round a node's larger neighbours are linked to its smallest one instead, then its smaller ones as well, until
each component is a star around its smallest node. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import free, materialise


class UnionFind:
    """The root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). A materialised row (node, root) for every node that has a link, roots themselves left out."""
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:  # a > b in each link; tables of least neighbours are written, so joins on hot nodes can be split
        least = materialise(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = now.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialise(large.distinct(), "links")
        free(now, least)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        now = materialise(small.filter("a <> b").distinct(), "links")
        free(large, least)
        # done when all are stars: no node has two smaller neighbours, and no centre has a smaller one
        several = now.groupBy("a").count().filter("count > 1").limit(1).count()
        if not several and not now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._keyfold_path = now._keyfold_path
            return out
