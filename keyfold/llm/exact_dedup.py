"""Exact dedup with Patricia tries.

Texts are the same when equal without white space. Each map task runs a combiner: a compressed radix trie over whole
normalised byte strings whose terminal nodes hold the best owner so far and the number of texts. Partial owners are dealt
to partitions by length and content hash, so a group with a third of all rows is one row from each map task. A reduce task
inserts the full strings of its partition into a trie of its own, in the order of lengths and hashes: texts are told apart
by their bytes. When a trie holds more than its budget after an insertion, its heaviest subtree leaves: in a map task as
partial owners into the shuffle, which is how it spills; in a reduce task, where rows of a text come together, as the
owners of texts that are complete. Nothing is written outside Spark.

Only (id, digest) pairs are shuffled to bring owners back to all rows; that join is an ordinary one, whose hot keys
adaptive execution splits.

Defined results: a null text is the empty one, and all texts without anything but white space are one group. Of equal
texts the one with the most code points stays, then the smallest id; a null id comes after all others. Rows that
repeat an id and text count each in group_size and share the verdict of that id. An empty table gives no rows. Of
further columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import materialise, one_of_each

#: Bytes of strings that a map task's trie may hold before it evicts a subtree.
TRIE_BYTES = 32 << 20


class Node:
    __slots__ = ("edges", "label", "owner")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.edges: dict[int, Node] = {}
        self.owner: tuple | None = None  # ((-code points, no id, id), count)


class PatriciaTrie:
    """A compressed radix trie of byte strings; each terminal node holds the least owner and a count."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held: dict[int, int] = {}  # bytes of labels below each first byte

    def insert(self, key: bytes, best: tuple, count: int = 1) -> None:
        node, at, first = self.root, 0, key[0] if key else -1
        while at < len(key):
            child = node.edges.get(key[at])
            if child is None:
                child = node.edges[key[at]] = Node(key[at:])
                self.held[first] = self.held.get(first, 0) + len(key) - at + 200
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = shared(label, key, at)
            middle = node.edges[key[at]] = Node(label[:n])
            child.label = label[n:]
            middle.edges[child.label[0]] = child
            self.held[first] = self.held.get(first, 0) + 200
            node, at = middle, at + n
        node.owner = (best, count) if node.owner is None else (min(node.owner[0], best), node.owner[1] + count)

    def size(self) -> int:
        return sum(self.held.values())

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, tuple, int]]:
        """Removes the subtree under a first byte, or all, and gives its strings with owners and counts."""
        if first is None:
            stack, self.root, self.held = [(self.root, b"")], Node(b""), {}
        else:
            stack = [(self.root.edges.pop(first), b"")]
            self.held.pop(first, None)
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, *node.owner
            stack += [(child, path) for child in node.edges.values()]

    def heaviest(self) -> int:
        return max(self.held, key=self.held.get)


def shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest prefix of label that key has at a position."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


PARTIAL = pa.schema([("len", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("points", pa.int64()), ("owner", pa.int64()), ("n", pa.int64())])
OWNERS = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _best(points: int, owner: int | None) -> tuple:
    return -points, owner is None, owner if owner is not None else 0


def _id(best: tuple) -> int | None:
    return None if best[1] else best[2]


def combine(it: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """The map side: (doc_id, norm, points) to partial owners."""
    import hashlib

    def out(entries: Iterator[tuple[bytes, tuple, int]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for norm, best, n in entries:
            rows.append((len(norm), hashlib.sha256(norm).hexdigest(), norm, -best[0], _id(best), n))
            held += len(norm)
            if held > 4 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PARTIAL.types)], schema=PARTIAL)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PARTIAL.types)], schema=PARTIAL)

    trie = PatriciaTrie()
    for b in it:
        for doc, norm, points in zip(b.column("doc_id").to_pylist(), b.column("norm"), b.column("points").to_pylist()):
            trie.insert(norm.as_py(), _best(points, doc))
            while trie.size() > budget and trie.held:
                yield from out(trie.take(trie.heaviest()))
    yield from out(trie.take())


def settle(it: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """The reduce side: a partition's partial owners, ordered by length and digest, to one owner per text."""
    import hashlib

    trie, now, rows = PatriciaTrie(), None, []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OWNERS.types)], schema=OWNERS)
        rows.clear()
        return out

    def done(first: int | None = None) -> None:
        rows.extend((hashlib.sha256(norm).hexdigest(), _id(best), n) for norm, best, n in trie.take(first))

    for b in it:
        for size, sha, norm, points, owner, n in zip(*(b.column(c).to_pylist() if c != "norm" else b.column(c) for c in PARTIAL.names)):
            if (size, sha) != now:  # the texts in the trie are complete
                while trie.size() > budget and trie.held:
                    done(trie.heaviest())
                now = (size, sha)
            trie.insert(norm.as_py(), _best(points, owner), n)
            if len(rows) >= 10_000:
                yield batch()
    done()
    if rows:
        yield batch()


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def normalised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.cast("binary").alias("norm"), F.length(whole).cast("long").alias("points"))


def trie_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id, group_size."""
    partial = normalised(docs, doc_id, text).mapInArrow(lambda it: combine(it, budget), _ddl(PARTIAL))
    dealt = partial.repartition("len", "sha").sortWithinPartitions("len", "sha")
    return dealt.mapInArrow(lambda it: settle(it, budget), _ddl(OWNERS))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = normalised(docs, doc_id, text).select("doc_id", F.sha2("norm", 256).alias("sha"))
    joined = rows.join(trie_owners(docs, doc_id, text, budget), "sha", "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _kept(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows as _row, with _id, _points and sha, and those of them that have their owner's id."""
    owners = trie_owners(docs, doc_id, text).filter("group_size > 1").select("sha", "keep_id")
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), F.length(whole).alias("_points"), F.sha2(norm, 256).alias("sha"))
    goes = (keyed["sha"] == owners["sha"]) & ~keyed["_id"].eqNullSafe(owners["keep_id"])
    return keyed, keyed.join(owners, goes, "left_anti")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that go are found by their digest and id; rows of texts that occur once have no entry in the join's other side.
    """
    return _kept(docs, doc_id, text)[1].select("_row.*")


def keep_single(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """keep_first, but one row of each text: of rows that repeat the owner's id, or lack one as it does, the longest."""
    keyed, kept = _kept(docs, doc_id, text)
    repeats = materialise(keyed.groupBy("sha", "_id").count().filter("count > 1").select("sha").distinct(), "repeats")
    return one_of_each(kept, "sha", repeats, F.col("_points"))
