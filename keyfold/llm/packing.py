"""Best-fit packing in rounds.

Each map task tokenises its texts, cuts those over the limit, and packs the remaining pieces best-fit decreasing.
Bins that are nearly full are done; the others are items of the next round, with their members inside, dealt to as
many tasks as a fixed number of items each gives. Rounds go on until one task has packed what is left, or until a
round of several tasks hardly joins any bins any more: then no two of those it saw fit together, and they stay as they
are. So no task ever holds more than `chunk` items, or those of one task's share of a round.

Every round is written to the shared folder: its tables are read more than once, and sequence numbers, which hold the
round, the task and a counter, must not change with a task that runs again.

Defined results: a null text is empty; every document has its closing token, so an empty one is a piece of length 1.
Rows that repeat, or have no id, are documents of their own. Ties go by id, then piece. An empty table gives no rows.
Further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import batches, materialise, partition_id
from keyfold.llm.token_counts import words_of
from keyfold.llm.tokens import encoder

CACHE_WORDS = 150_000
_ids: dict[str, dict[bytes, bytes]] = {}

FIELDS = ["doc_id", "piece", "start", "length", "crc", "offset"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
BINS = "seq long, fill long, members array<struct<doc_id: long, piece: int, start: long, length: long, crc: long, offset: long>>"


def pieces(it: Iterator[pa.RecordBatch], path: str, limit: int, end: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc) of every document, in the order of its rows."""
    cache = _ids.setdefault(path, {})
    closing = np.array([end], dtype="<u4").tobytes()
    for b in batches(it, 2000):
        words = [words_of(t) for t in b.column("text").to_pylist()]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        missed = list(set(chain.from_iterable(words)) - cache.keys())
        if missed:
            cache.update(zip(missed, map(bytes, encoder(path).encode(missed))))
        get = cache.__getitem__
        for doc, w in zip(b.column("doc_id").to_pylist(), words):
            ids = b"".join(map(get, w)) + closing
            for k, at in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[at : at + 4 * limit]
                yield doc, k, at // 4, len(part) // 4, zlib.crc32(part)


def best_fit(items: list[tuple[int, tuple]], limit: int) -> Iterator[list[int]]:
    """Bins as lists of item numbers. Each item, the longest first, goes where it leaves the least room."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room for exactly r
    for i in order:
        size = items[i][0]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
            room -= size
        else:
            at, room = len(bins), limit - size
            bins.append([i])
        if room:
            open_at.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


class Writer:
    """Gathers bins and gives them as batches."""

    def __init__(self, round_no: int) -> None:
        self.next = (round_no << 56) | (partition_id() << 30)
        self.clear()

    def clear(self) -> None:
        self.seq, self.fill, self.cuts = [], [], [0]
        self.columns: list[list] = [[] for _ in FIELDS]

    def add(self, members: list[tuple]) -> None:
        """Members with their own offsets; the bin's rows are theirs."""
        self.seq.append(self.next)
        self.next += 1
        self.fill.append(sum(m[3] for m in members))
        for c, v in zip(self.columns, zip(*members)):
            c.extend(v)
        self.cuts.append(len(self.columns[0]))

    def batch(self) -> pa.RecordBatch:
        struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(self.columns, KINDS)], names=FIELDS)
        out = pa.RecordBatch.from_arrays([pa.array(self.seq, pa.int64()), pa.array(self.fill, pa.int64()), pa.ListArray.from_arrays(pa.array(self.cuts, pa.int32()), struct)], names=["seq", "fill", "members"])
        self.clear()
        return out


def _id_key(doc: int | None) -> tuple:
    return doc is None, doc or 0


def _joined(groups: list[list[tuple]]) -> list[tuple]:
    """One bin's members from those of several, with their offsets set."""
    out, offset = [], 0
    for members in groups:
        for m in members:
            out.append((*m[:5], offset))
            offset += m[3]
    return out


def _packed(items: list[list[tuple]], limit: int, writer: Writer) -> Iterator[pa.RecordBatch]:
    """items: the members of each. Gives the bins."""
    sized = [(sum(m[3] for m in members), (*_id_key(members[0][0]), members[0][1])) for members in items]
    for found in best_fit(sized, limit):
        writer.add(_joined([items[i] for i in found]))
        if len(writer.seq) >= 5000:
            yield writer.batch()


def first_round(it: Iterator[pa.RecordBatch], path: str, limit: int, end: int, chunk: int) -> Iterator[pa.RecordBatch]:
    writer, items = Writer(0), []
    for p in pieces(it, path, limit, end):
        if p[3] == limit:
            writer.add([(*p, 0)])
        else:
            items.append([(*p, 0)])
        if len(items) >= chunk:
            yield from _packed(items, limit, writer)
            items = []
        if len(writer.seq) >= 5000:
            yield writer.batch()
    yield from _packed(items, limit, writer)
    yield writer.batch()


def next_round(it: Iterator[pa.RecordBatch], round_no: int, limit: int, chunk: int) -> Iterator[pa.RecordBatch]:
    writer, items = Writer(round_no), []
    for b in it:
        for members in b.column("members").to_pylist():
            items.append([tuple(m[f] for f in FIELDS) for m in members])
        if len(items) >= 2 * chunk:
            yield from _packed(items, limit, writer)
            items = []
    yield from _packed(items, limit, writer)
    yield writer.batch()


def pack(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, slack: int = 8, chunk: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    slack: the room that a nearly full bin may have. chunk: items that a task packs at a time.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    bins = materialise(rows.mapInArrow(lambda it: first_round(it, path, limit, end, chunk), BINS), "bins")
    full = F.col("fill") >= limit - slack
    done, left = [bins.filter(full)], bins.filter(~full)
    n, round_no = left.count(), 0
    while n > 1:
        round_no, tasks = round_no + 1, -(-n // chunk)
        bins = materialise(left.repartition(tasks).mapInArrow(lambda it, r=round_no: next_round(it, r, limit, chunk), BINS), "bins")
        done.append(bins.filter(full))
        left, before = bins.filter(~full), n
        n = left.count()
        if tasks == 1 or n > 0.98 * before:
            break
    out = left
    for d in done:
        out = out.unionByName(d)
    m = F.explode("members").alias("m")
    return out.select(F.col("seq").alias("sequence_id"), m).select("m.doc_id", "m.piece", "m.start", "m.length", F.col("m.crc").alias("ids_crc32"), "sequence_id", "m.offset")
