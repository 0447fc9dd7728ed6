"""Token counts by a two-tier lookup on the map side.

A first pass over all texts leaves from each task a Misra-Gries summary of its frequent pre-tokens (white-space-
delimited words); a tree of merges makes one summary of them, of a fixed number of entries. With the lengths of those
pre-tokens in tokens it is broadcast as a compact table: at most `entries` words of at most 64 bytes, so its size is
bounded whatever the corpus. The second pass looks words up there and encodes the rest through a cache that each
worker process keeps across tasks. No pre-token is ever shuffled, and the table only saves work: a count never depends
on what is in it.

Defined results: a null text is the empty one, with 0 bytes and 0 tokens. Long texts are split and looked up whole.
Rows that repeat, ties and null ids are rows like others; an empty table gives no rows. Further columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import ASCII_LOWER, batches, materialise
from keyfold.llm.tokens import encoder

#: Summaries that one task merges.
FAN_IN = 32
#: Words that a worker keeps beside the broadcast table.
CACHE_WORDS = 250_000

_lengths: dict[tuple[str, int], dict[bytes, int]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, in lower case where no special token can be in it."""
    if not text:
        return []
    return (text if b"<|" in text else text.translate(ASCII_LOWER)).split()


def shrink(counts: Counter, entries: int) -> Counter:
    """Misra-Gries: takes the count of the entry after the last kept one from all."""
    if len(counts) <= entries:
        return counts
    floor = sorted(counts.values(), reverse=True)[entries]
    return Counter({w: c - floor for w, c in counts.items() if c > floor})


def _row(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"words": pa.array([list(counts.keys())], pa.list_(pa.binary())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})


def summarise(it: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches(it, 2000):
        for t in b.column("text").to_pylist():
            counts.update(words_of(t))
        if len(counts) > 16 * entries:
            counts = shrink(counts, entries)
    counts = shrink(Counter({w: c for w, c in counts.items() if len(w) <= 64}), entries)
    if counts:
        yield _row(counts)


def merge(it: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in it:
        for words, n in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
            counts.update(dict(zip(words, n)))
            counts = shrink(counts, entries)
    if counts:
        yield _row(counts)


def frequent_words(docs: DataFrame, entries: int) -> list[bytes]:
    """At most `entries` words, among them all with a share over 1 / entries of all words."""
    kind = "words array<binary>, counts array<long>"
    parts = materialise(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lambda it: summarise(it, entries), kind), "frequent")
    n = parts.count()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(lambda it: merge(it, entries), kind)
        parts = materialise(parts, "frequent") if n > 1 else parts
    found = parts.first()
    return [bytes(w) for w in found["words"]] if found else []


def count_tokens(it: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    frequent: dict[bytes, int] = table.value
    key = (path, table.id if hasattr(table, "id") else id(table))
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = dict(frequent)
    cache = _lengths[key]
    for b in batches(it, 2000):
        texts = b.column("text").to_pylist()
        words = [words_of(t) for t in texts]
        if len(cache) > len(frequent) + CACHE_WORDS:
            cache.clear()
            cache.update(frequent)
        missed = list(set(chain.from_iterable(words)) - cache.keys())
        if missed:
            cache.update(zip(missed, map(len, encoder(path).encode(missed))))
        get = cache.__getitem__
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, entries: int = 8192, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    words = frequent_words(rows, entries)
    lengths = dict(zip(words, map(len, encoder(path).encode(words)))) if words else {}
    table = docs.sparkSession.sparkContext.broadcast(lengths)
    out = rows.mapInArrow(lambda it: count_tokens(it, path, table), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
