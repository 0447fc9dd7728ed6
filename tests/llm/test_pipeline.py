"""Queries of the corpus operators against SQL, and the pipeline against plain Python."""

from collections import Counter

import pytest
from oracles import assert_same, database

from keyfold.llm.queries import QUERIES
from keyfold.llm.sql import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLE_SQL[name])


def test_stages(spark):
    import corpus_pipeline
    from test_operators import brute_components, brute_rules, key

    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), f"test-{name}")
        after = docs.collect()
        assert docs.columns == columns and set(after) <= set(before)
        ids = Counter(r.doc_id for r in after)
        if name == "quality":
            base = {r.doc_id for r in before for c in [brute_rules(r.text)] if not (c[0] < 20 or 100 * c[4] > 30 * c[0])}
            assert set(ids) <= base and len(ids) > 0.95 * len(base)
        elif name == "exact":
            best = {}
            for r in before:
                k = "".join(r.text.split())
                best[k] = min(best.get(k, (0, 1 << 60)), (-len(r.text), r.doc_id))
            assert set(ids) == {b[1] for b in best.values()}
        elif name == "near":
            assert set(ids) == {k[1] for k, _, c in brute_components([(r.doc_id, r.text) for r in before], percent=80) if c == k}
        else:
            assert max(ids.values()) <= 3 and all(key((i,)) for i in ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert sum(1 for _ in packed) == corpus_pipeline.run(spark, FOLDER).count()


def test_odd_rows(spark, tmp_path):
    """Rows with nulls, empty and long texts, that repeat, or without ids; further columns stay. And an empty table."""
    import random

    import corpus_pipeline
    from test_operators import prose

    rng = random.Random(13)
    good = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(good)]
    rows += [rows[3]] * 4 + [(None, good[5], None, None, 1)] * 3 + [(None, "no id " + prose(rng, 50), "en", "s1", 2)] * 2
    rows += [(50, None, "en", "s0", 3), (51, "", "en", None, 4), (52, "too short", "en", "s0", 5), (None, None, None, None, None), (53, "word" * 30000 + " " + prose(rng, 40), "en", "s2", 6)]
    rows += [(54, good[7] + " more", "en", "s1", 7), (55, good[8].replace(" ", "\n"), "en", "s1", 8)]
    schema = "doc_id long, text string, lang string, source string, _row long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        seen[name] = docs.collect()
    assert all(r.text and len(r.text.split()) >= 20 for r in seen["quality"]) and len(seen["quality"]) == len(rows) - 4
    texts = ["".join(r.text.split()) for r in seen["exact"]]
    assert len(texts) == len(set(texts)) == 43  # 40, the one without an id, the long one, and that with a word more
    assert len(seen["near"]) == 42 and Counter(r.doc_id for r in seen["near"]) == Counter([*range(40), 53, None])
    assert {r.doc_id for r in seen["mix"]} <= {r.doc_id for r in seen["near"]} and max(Counter(r.text for r in seen["mix"]).values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in seen["mix"])
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
