"""Word counts and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import hash_bucket, tokens
from keyfold.operators import map_update as mu
from keyfold.operators import term_stats
from keyfold.operators.folds import Sum
from keyfold.plans import Pipeline
from keyfold.sources import text as text_source
from keyfold.sources.tables import table
from keyfold.storage import checkpoint_dir

BUCKETS = 4096


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def word_count(spark: SparkSession, sf: str) -> DataFrame:
    """Map each word to 1, fold by sum into a fresh collection."""
    emit = lambda df: df.select(F.explode(tokens("text")).alias("word"), F.lit(1).alias("msg"))
    return mu.map_update(_docs(spark, sf), None, ("word",), emit, {"cnt": Sum()})


def word_count_topk(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats.word_count(_docs(spark, sf)).orderBy(F.desc("cnt"), "word").limit(10)


def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats.word_count(_docs(spark, sf)).agg(F.count(F.lit(1)).alias("n_words"))


def line_count(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats.line_count(_docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("value")))


def line_count_write(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts through the pipeline, written as lines of text and read back."""
    import uuid

    path = f"{checkpoint_dir(spark)}/keyfold-lines-{uuid.uuid4().hex}"
    p = Pipeline(spark)
    lines = p.collection("lines", _docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")))
    counts = p.placeholder("line string, cnt long", ["line"], defaults={"cnt": 0}, name="counts")
    p.map_update(lines, counts, lambda df: df.select("line", F.lit(1).alias("msg")), {"cnt": Sum()})
    p.write(counts, path, lambda df: df.select(F.concat_ws(" ", F.col("line"), F.col("cnt").cast("string"))))
    p.run()
    return text_source.lines(spark, path).select(F.col("value").alias("line"))


def tfidf_idf_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    out = term_stats.idf_weights(docs, docs.count())
    return out.select("doc_id", "term", F.round("tf", 6).alias("tf"), F.round("tf_idf", 6).alias("tf_idf"))


def tfidf_raw_over_df_sum(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats.count_over_df(_docs(spark, sf)).agg(F.round(F.sum("tf_idf"), 4).alias("total"))


def tfidf_log(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return term_stats.log_weights(docs, docs.count(), BUCKETS).select("doc_id", F.col("term").cast("long").alias("term"), F.round("tf_idf", 6).alias("tf_idf"))


def hash_features(spark: SparkSession, sf: str) -> DataFrame:
    words = _docs(spark, sf).select(F.explode(tokens("text")).alias("word"))
    return words.groupBy(hash_bucket("word", 1024).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


QUERIES = {f.__name__: f for f in (word_count, word_count_topk, distinct_words, line_count, line_count_write, tfidf_idf_only, tfidf_raw_over_df_sum, tfidf_log, hash_features)}

_WORDS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> '')) AS word FROM documents"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"SELECT doc_id, unnest(list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n.,()''\":;!?<>]+'), lambda x: x <> '')) AS term FROM documents"


def _weights(bucket: str, value: str) -> str:
    term = f"('0x' || substr(md5(term), 1, 8))::UBIGINT % {bucket}" if bucket else "term"
    return f"""
WITH t AS ({_TERMS}), h AS (SELECT doc_id, {term} AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM h GROUP BY doc_id, term),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT {value} FROM c JOIN d USING (term), n
"""


ORACLE_SQL = {
    "word_count": f"SELECT word, count(*) AS cnt FROM ({_WORDS}) GROUP BY word",
    "word_count_topk": f"SELECT word, count(*) AS cnt FROM ({_WORDS}) GROUP BY word ORDER BY cnt DESC, word LIMIT 10",
    "distinct_words": f"SELECT count(DISTINCT word) AS n_words FROM ({_WORDS})",
    "line_count": "SELECT line, count(*) AS cnt FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line",
    "line_count_write": "SELECT x || ' ' || n AS line FROM (SELECT x, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY x)",
    "tfidf_idf_only": _weights("", "doc_id, term, round(cnt / total, 6) AS tf, round(ln(n / df), 6) AS tf_idf"),
    "tfidf_raw_over_df_sum": _weights(str(2 << 18), "round(sum(cnt / df), 4) AS total"),
    "tfidf_log": _weights(str(BUCKETS), "doc_id, term::BIGINT AS term, round(cnt / total * ln(n / df), 6) AS tf_idf"),
    "hash_features": f"SELECT (('0x' || substr(md5(word), 1, 8))::UBIGINT % 1024)::BIGINT AS bucket, count(*) AS cnt FROM ({_WORDS}) GROUP BY 1",
}
