"""Word counts and term weights of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.functions import tokens
from keyfold.functions.columns import PUNCTUATION

#: By byte: whether it is part of a word, and what it is in lower case.
_INSIDE = np.array([not re.fullmatch(PUNCTUATION, chr(c)) for c in range(256)])
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt), words as they are between blanks."""
    return docs.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def line_count(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line, cnt) of distinct lines."""
    return lines.groupBy(F.col(value).alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What words() makes of each text, one after another, and how many each text has. Separators and the letters that are
    lowered are single bytes, so bytes are compared and no text is decoded."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _INSIDE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < len(raw)]
    first[begin] = inside[begin]
    n = np.diff(np.searchsorted(np.flatnonzero(first), at))
    offsets = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_LOWERED[raw[inside]])), n


def _chunks(it: Iterator[pa.RecordBatch], buckets: int | None, most: int = 8_000_000) -> Iterator[tuple]:
    """Of (id, text), some MB of texts at a time: ids, terms, and by row and term: the row, the number of the term, how often
    the row has it; and how many words each row has."""
    for b in it:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
        cut = np.searchsorted(size, np.arange(most, size[-1] if len(size) else 0, most), "right")
        for lo, hi in pairwise(np.unique(np.concatenate(([0], cut, [len(size)])))):
            found, total = split_words(b.column(1).slice(lo, hi - lo))
            if not len(found):
                continue
            coded = found.dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy()
            if buckets:
                bucket = np.array([int.from_bytes(md5(w).digest()[:4], "big") % buckets for w in terms.cast(pa.binary()).to_pylist()], np.int64)
                terms, place = np.unique(bucket, return_inverse=True)
                terms, code = pa.array(terms), place[code]
            key, cnt = np.unique(np.repeat(np.arange(hi - lo), total) * len(terms) + code, return_counts=True)
            yield b.column(0).slice(lo, hi - lo), terms, key // len(terms), key % len(terms), cnt, total


def _row_counts(docs: DataFrame, buckets: int | None) -> DataFrame:
    """(doc_id, term, cnt, total) of each row of (doc_id, text) by itself, with nothing shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, terms, row, term, cnt, total in _chunks(it, buckets):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), terms.take(pa.array(term)), pa.array(cnt), pa.array(total[row])], names=["doc_id", "term", "cnt", "total"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term {'long' if buckets else 'string'}, cnt long, total long")


def _row_frequency(docs: DataFrame, buckets: int | None) -> DataFrame:
    """(term, df) where each row of (doc_id, text) is a document: rows of the same term, to be summed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets or 0, np.int64)
        for _, terms, _, term, _, _ in _chunks(it, buckets):
            df = np.bincount(term, minlength=len(terms))
            if buckets:
                sums[terms.to_numpy()] += df
            else:
                yield pa.RecordBatch.from_arrays([terms, pa.array(df)], names=["term", "df"])
        used = np.flatnonzero(sums)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["term", "df"])

    return docs.mapInArrow(run, f"term {'long' if buckets else 'string'}, df long")


def _few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Written rows, broadcast to joins if they are that few."""
    rows = storage.cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def _frequent(df: DataFrame, kept: int = 131_072) -> DataFrame:
    """Of (term, df) the terms of a high df: at most so many, of at most 64 bytes."""
    level = F.floor(F.log2("df") * 8).cast("int").alias("level")
    terms = df.filter(F.octet_length(F.col("term").cast("string")) <= 64).select("term", "df", level)
    lowest, n = None, 0
    for r in sorted(terms.groupBy("level").count().collect(), reverse=True):  # as many as df has digits, times a constant
        n += r["count"]
        if n > kept:
            break
        lowest = r["level"]
    return terms.filter(F.col("level") >= lowest if lowest is not None else F.lit(False)).select("term", "df")


def with_df(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, cnt, total, df) of lower-cased words, or of their hashes: how often a document has a term, its number of
    words, and how many documents have the term. only: ids (doc_id) of the documents to give; df is that of all.

    Texts are counted a row at a time, again in each pass, as that takes less than writing or shuffling counts. Rows that
    share an id are one document, and only their counts are shuffled. df is broadcast up to a bound: all of it for
    hashes, else that of frequent terms, and rows of the others meet it in a join."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    again = _few(ids) if ids.limit(1).count() else None
    same = None if again is None else docs["doc_id"].eqNullSafe(again["_id"])
    single = docs if again is None else docs.join(again, same, "left_anti")
    rows = _row_frequency(single, buckets)
    if again is not None:
        parts = storage.cut(_row_counts(docs.join(again, same, "left_semi"), buckets).groupBy("doc_id", "term").agg(F.sum("cnt").alias("cnt")))
        totals = parts.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("cnt").alias("total"))
        shared = parts.join(totals, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "term", "cnt", "total")
        rows = rows.union(parts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    df = storage.cut(rows.groupBy("term").agg(F.sum("df").alias("df")))
    if only is not None:
        some = _few(only.select(F.col("doc_id").alias("_only")).distinct())
        single = single.join(some, F.col("doc_id") == F.col("_only"), "left_semi")
    counts = _row_counts(single, buckets)
    if again is not None:
        counts = counts.union(shared if only is None else shared.join(some, F.col("doc_id") == F.col("_only"), "left_semi"))
    if buckets and buckets <= 1 << 20:
        return counts.join(F.broadcast(df), "term")
    frequent = storage.cut(_frequent(df))
    rare = df.join(F.broadcast(frequent), "term", "left_anti")
    out = counts.join(F.broadcast(frequent), "term")
    if not rare.limit(1).count():
        return out
    return out.unionByName(counts.join(F.broadcast(frequent), "term", "left_anti").join(rare, "term"))


def idf_weights(docs: DataFrame, n_docs: int, text: str = "text") -> DataFrame:
    """(doc_id, term, tf, tf_idf) of lower-cased words: tf is the share in the document, tf_idf is ln(n_docs / df)."""
    return with_df(docs, text).select("doc_id", "term", (F.col("cnt") / F.col("total")).alias("tf"), F.log(F.lit(n_docs) / F.col("df")).alias("tf_idf"))


def count_over_df(docs: DataFrame, buckets: int = 2 << 18, text: str = "text") -> DataFrame:
    """(doc_id, term, tf_idf) of hashed words, lower-cased: the count in the document over df."""
    return with_df(docs, text, buckets=buckets).select("doc_id", "term", (F.col("cnt") / F.col("df")).alias("tf_idf"))


def log_weights(docs: DataFrame, n_docs: int, buckets: int, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf_idf) of hashed words: the share in the document times ln(n_docs / df). only: ids (doc_id) of the
    documents to give weights of; df is that of all."""
    weight = F.col("cnt") / F.col("total") * F.log(F.lit(n_docs) / F.col("df"))
    return with_df(docs, text, buckets=buckets, only=only).select("doc_id", "term", weight.alias("tf_idf"))


def feature_points(weights: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(id, y, x of (i, v)): sparse points of labelled documents."""
    points = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("term").cast("int").alias("i"), F.col("tf_idf").cast("double").alias("v")))).alias("x"))
    return points.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").select(F.col("doc_id").alias("id"), "y", "x")

