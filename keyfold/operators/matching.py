"""Matches of small labelled patterns, as chains of equi-joins.

Edges are first cut down to those whose ends carry labels that some edge of the pattern asks for, so every join reads
only what can match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """nodes: label by name. edges: pairs of names, each but the first sharing a name with one before it. different:
    pairs of nodes that must not be the same vertex."""

    nodes: dict[str, str]
    edges: tuple[tuple[str, str], ...]
    different: tuple[tuple[str, str], ...] = ()


#: a -> b, a -> c, c -> b, c -> b2, b2 -> d with b and b2 different.
DIAMOND = Pattern({"a": "a", "b": "b", "c": "c", "b2": "b", "d": "d"}, (("a", "b"), ("c", "b"), ("a", "c"), ("c", "b2"), ("b2", "d")), (("b", "b2"),))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, src_label, dst, dst_label) from edges and (id, label)."""
    left = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    right = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.select("src", "dst").distinct().join(left, "src").join(right, "dst").select("src", "src_label", "dst", "dst_label")


def labelled_edges(rows: DataFrame) -> DataFrame:
    """The same from rows (id, label, outlinks of (id, label))."""
    return rows.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.explode("outlinks").alias("o")).select("src", "src_label", F.col("o.id").alias("dst"), F.col("o.label").alias("dst_label")).distinct()


def matches(edges: DataFrame, pattern: Pattern = DIAMOND) -> DataFrame:
    """A row per homomorphic match, a column per node of the pattern."""
    found: DataFrame | None = None
    for u, v in pattern.edges:
        step = edges.filter((F.col("src_label") == pattern.nodes[u]) & (F.col("dst_label") == pattern.nodes[v])).select(F.col("src").alias(u), F.col("dst").alias(v))
        if u == v:
            step = step.filter(F.col(u) == F.col(v)).select(u)
        if found is None:
            found = step
        else:
            shared = [n for n in dict.fromkeys((u, v)) if n in found.columns]
            if not shared:
                raise ValueError(f"edge {(u, v)} shares no node with those before it")
            found = found.join(step, shared)
        for x, y in pattern.different:
            if x in found.columns and y in found.columns and {x, y} & {u, v}:
                found = found.filter(F.col(x) != F.col(y))
    return found.select(*pattern.nodes)


def sibling_filtered(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Of matches of DIAMOND, those whose b links on to some child labelled c of its a."""
    a_c = edges.filter("src_label = 'a' and dst_label = 'c'").select(F.col("src").alias("a"), F.col("dst").alias("_c"))
    b_c = edges.filter("src_label = 'b' and dst_label = 'c'").select(F.col("src").alias("b"), F.col("dst").alias("_c"))
    return found.join(a_c.join(b_c, "_c").select("a", "b").distinct(), ["a", "b"], "left_semi")


def match_count(edges: DataFrame, pattern: Pattern = DIAMOND, sibling: bool = False) -> DataFrame:
    found = matches(edges, pattern)
    return (sibling_filtered(edges, found) if sibling else found).agg(F.count(F.lit(1)).alias("matches"))
