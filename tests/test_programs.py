"""Sources, graphs, matching, learning and streams on small fixtures."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.functions import ascii_lower, hash_bucket, tokens, words
from keyfold.operators import crawl, graph, learning, matching, relational, term_stats
from keyfold.sources import tables, text
from keyfold.streaming import windows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ranks(df):
    return {r.vertex: pytest.approx(r.pr) for r in df.collect()}


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_records_end_with_their_line(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x\n</doc>\ny\n</doc>\nz")
    assert [r.value for r in text.records(spark, str(tmp_path)).orderBy("number").collect()] == [" x", " y"]


def test_line_limits_and_lazy_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    (tmp_path / "b.txt").write_text("4\n5\n")
    assert sorted(r.value for r in text.lines(spark, str(tmp_path), 2).collect()) == ["1", "2", "4", "5"]
    assert text.lines(spark, str(tmp_path), 0).count() == 5 and text.lazy_lines(spark, str(tmp_path)).count() == 5
    assert text.whole_files(spark, str(tmp_path)).count() == 2
    assert sorted(r.length for r in text.files(spark, str(tmp_path)).collect()) == [4, 6]


def test_files_that_are_read_whole_have_a_bound(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:04d}" * (i % 4) + ("\n</doc>" if i % 3 else ""),) for i in range(500)] + [("y" * 900,), (None,), ("é" * 40,)], "value string").coalesce(2)
    text.write_lines(rows, str(tmp_path / "some"), 200)
    text.write_lines(rows, str(tmp_path / "all"))
    some, everything = [sorted(p.read_bytes() for p in (tmp_path / f).glob("part-*.txt")) for f in ("some", "all")]
    assert len(everything) == 2 and len(some) > 20 and sorted(map(len, some))[-1] == 901 and sorted(map(len, some))[-2] <= 200
    assert sorted(b"".join(some).split(b"\n")) == sorted(b"".join(everything).split(b"\n"))
    text.write_lines(rows.limit(0), str(tmp_path / "none"), 200)
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    assert text.records(spark, str(tmp_path / "some")).count() > 0


def test_grammars(spark):
    r = text.libsvm(lines(spark, "1 3:0.5 7:2")).first()
    assert r.y == 1 and [(p.i, p.v) for p in r.x] == [(2, 0.5), (6, 2.0)]
    r = text.adjacency(lines(spark, "4 2\t7 8", "", "5 0")).collect()
    assert [(x.vertex, x.outlinks) for x in r] == [(4, [7, 8]), (5, [])]
    r = text.labelled_adjacency(lines(spark, "1 ab 2 b 3 cc", "9 d")).collect()
    assert [(x.id, x.label, [(o.id, o.label) for o in x.outlinks]) for x in r] == [(1, "a", [(2, "b"), (3, "c")]), (9, "d", [])]
    assert tuple(text.ratings(lines(spark, "1 2 3.5")).first()) == (1, 2, 3.5)
    assert tuple(text.scores(lines(spark, "1 2.5")).first()) == (1, 2.5)
    assert text.titled_documents(lines(spark, '<doc id="1" title="A b">text')).first().title == "A b"
    assert text.line_documents(lines(spark, "a b")).first().text == "a b"
    assert lines(spark, "u,,v").select(text.seeds(F.col("value")).alias("s")).first().s == ["u", "v"]


def test_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write(df, str(tmp_path / kind), kind)
        assert sorted(map(tuple, tables.read(spark, str(tmp_path / kind), kind, "k long, v string").collect())) == [(1, "a"), (2, "b")]


def test_tokens(spark):
    df = lines(spark, "Été, (A)b\tc!\n d", None)
    assert [r.t for r in df.select(tokens("value").alias("t")).collect()] == [["Été,", "(A)b", "c!", "d"], []]
    assert [r.t for r in df.select(words("value").alias("t")).collect()] == [["Été", "a", "b", "c", "d"], []]
    assert df.select(ascii_lower("value").alias("t")).first().t == "Été, (a)b\tc!\n d"
    assert 0 <= df.select(hash_bucket("value", 7).alias("b")).first().b < 7


def test_rank_fixed_points(spark):
    two = edges(spark, [(1, 2), (2, 1)])
    n = 4
    assert ranks(graph.pagerank_bsp(two, n)) == {1: 1.0, 2: 1.0}
    assert ranks(graph.pagerank_delta(two, n)) == {1: 1 - 0.85**n, 2: 1 - 0.85**n}
    assert ranks(graph.pagerank_cumulative(two, n)) == {1: 0.15 * 1.85**n, 2: 0.15 * 1.85**n}
    assert ranks(graph.pagerank_with_links(graph.adjacency_of(two), rounds=n)) == {1: 0.15 * 1.85**n, 2: 0.15 * 1.85**n}
    assert graph.top_ranks(graph.pagerank_bsp(two, 1)).count() == 2


def test_ranks_do_not_depend_on_checkpoints(spark):
    g = edges(spark, [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (1, 2)])
    assert ranks(graph.pagerank_delta(g, 5, checkpoint_every=2)) == {r.vertex: r.pr for r in graph.pagerank_delta(g, 5, checkpoint_every=0).collect()}


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, value double")
    b = spark.createDataFrame([(1, 1.5), (2, 1.0)], "id int, value double")
    assert graph.compare(a, b).first().l1 == 1.5 and graph.total(a).first().total == 3.0


def test_hops_and_closure(spark):
    g = edges(spark, [(1, 2), (1, 3), (2, 3), (3, 1), (8, 9)])
    assert {r.vertex: r.dist for r in graph.shortest_hops(g, 1, 10).collect()} == {1: 0, 2: 1, 3: 1, 8: None, 9: None}
    assert {r.vertex: r.dist for r in graph.shortest_hops(g, 1, 10, 2147483647).collect()}[9] == 2147483647
    seeds = spark.createDataFrame([(2,)], "vertex long")
    assert {r.vertex: r.status for r in graph.closure(g, seeds).collect()} == {2: "Done", 3: "Done", 1: "Done"}
    assert {r.vertex: r.status for r in graph.closure(g, seeds, 1).collect()} == {2: "Done", 3: "ToFetch"}


def test_patterns(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b"), (5, "d")], "id long, label string")
    g = [(1, 2), (1, 3), (3, 2), (3, 4), (4, 5)]
    plain = lambda e, **k: matching.match_count(matching.labelled(edges(spark, e), labels), **k).first().matches
    assert plain(g) == 1 and plain(g, sibling=True) == 0
    assert plain([*g, (2, 3)]) == 1 and plain([*g, (2, 3)], sibling=True) == 1
    rows = text.labelled_adjacency(lines(spark, "1 a 2 b 3 c", "3 c 2 b 4 b", "4 b 5 d"))
    assert matching.match_count(matching.labelled_edges(rows)).first().matches == 1


def test_term_weights(spark):
    docs = spark.createDataFrame([(1, "A a b"), (2, "b c")], "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.tf, r.tf_idf) for r in term_stats.idf_weights(docs, 2).collect()}
    assert got[1, "a"] == (pytest.approx(2 / 3), pytest.approx(np.log(2))) and got[1, "b"] == (pytest.approx(1 / 3), 0.0)


def test_weights_of_odd_documents(spark):
    from collections import Counter
    from math import log

    texts = [(1, "A a\tb.c"), (2, "É\u00a0é,(x) x"), (2, "x\rx Y"), (None, "y"), (None, "a?y"), (3, None), (4, ""), (5, " ., "), (6, "w" * 70 + " a"), (7, "\n'b'")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    split = lambda t: [w for w in re.split(r"""[ \t\n.,()'":;!?<>]+""", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    want = {}
    for i, t in texts:
        want.setdefault(i, Counter()).update(split(t))
    df = Counter(w for c in want.values() for w in c)
    got = {(r.doc_id, r.term): (r.cnt, r.total, r.df) for r in term_stats.with_df(docs).collect()}
    assert got == {(i, w): (n, sum(c.values()), df[w]) for i, c in want.items() for w, n in c.items()}
    few = spark.createDataFrame([(2,), (6,), (2,)], "doc_id long")
    hashed = term_stats.log_weights(docs, len(texts), 1 << 20, only=few).collect()
    assert sorted(r.tf_idf for r in hashed) == pytest.approx(sorted(n / sum(want[i].values()) * log(len(texts) / df[w]) for i in (2, 6) for w, n in want[i].items()))


def test_terms_beyond_those_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(1, 30)], "doc_id long, text string")
    monkeypatch.setattr(term_stats._frequent, "__defaults__", (7,))
    assert {(r.doc_id, r.term): r.df for r in term_stats.with_df(docs).collect()} == {(i, f"w{k}"): 29 - k for i in range(1, 30) for k in range(i)}



def test_online_kmeans_as_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    start = [list(map(float, r)) for r in x[:4]]
    got, n = learning.online_kmeans(points, start, 2, 3)
    mid, cnt = np.array(start), np.ones(4)
    for _ in range(2):
        dm, dc = np.zeros_like(mid), np.zeros(4)
        for p in range(3):
            own, c = mid.copy(), cnt.copy()
            for i in range(p, 60, 3):
                k = ((own - x[i]) ** 2).sum(1).argmin()
                c[k] += 1
                own[k] -= (own[k] - x[i]) / c[k]
            dm, dc = dm + own - mid, dc + c - cnt
        mid, cnt = mid + dm, cnt + dc
    assert np.allclose(got, mid) and np.allclose(n, cnt)


def test_online_kmeans_with_its_settings(spark):
    """Learning rate, several passes, and each so many-th point only; dense and sparse points alike."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(50, 4)), 3) * (rng.random((50, 4)) > 0.4)
    dense = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    sparse = spark.createDataFrame([(i, [(j, float(v)) for j, v in enumerate(r) if v]) for i, r in enumerate(x)], "vec_id long, embedding array<struct<i:int,v:double>>")
    start = x[:3].tolist()
    for alpha, replicate, every in ((0.1, 3, 1), (0.5, 2, 4), (1.0, 1, 40)):
        mid, cnt = np.array(start), np.ones(3)
        for _ in range(2):
            dm, dc = np.zeros_like(mid), np.zeros(3)
            for p in range(2):
                own, c = mid.copy(), cnt.copy()
                for n, i in enumerate(list(range(p, 50, 2)) * replicate, 1):
                    if n % every == 0:
                        k = ((own - x[i]) ** 2).sum(1).argmin()
                        c[k] += 1
                        own[k] -= alpha / c[k] * (own[k] - x[i])
                dm, dc = dm + own - mid, dc + c - cnt
            mid, cnt = mid + dm, cnt + dc
        for points in (dense, sparse):
            got, n = learning.online_kmeans(points, start, 2, 2, alpha=alpha, replicate=replicate, every=every)
            assert np.allclose(got, mid) and np.allclose(n, cnt)


def test_lloyd_never_gets_worse(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(80, 2)))], "vec_id long, embedding array<double>")
    start = learning.pick_centres(points, 5)
    errors = [learning.mean_squared_error(learning.assign(points, learning.lloyd(points, start, n))).first().mse for n in range(4)]
    assert errors == sorted(errors, reverse=True)
    by_sql = {r.vec_id: r.n.c for r in points.select("vec_id", learning.nearest(start).alias("n")).collect()}
    assert {r.vec_id: r.c for r in learning.assign(points, start).collect()} == by_sql


def test_regression_learns(spark):
    rows = [(i, i % 7 / 7.0, 1 if i % 7 > 3 else -1) for i in range(140)]
    points = spark.createDataFrame(rows, "id long, x double, y int")
    w = learning.dense_logistic(points, ["x"], "y", 60, 1.0, 4, "id")
    assert learning.dense_accuracy(points, ["x"], "y", w).first().accuracy == 1.0
    sparse = points.select("id", F.greatest("y", F.lit(0)).alias("y"), F.array(F.struct(F.lit(0).alias("i"), (F.col("x") - 0.5).alias("v"))).alias("x"))
    params = learning.sparse_logistic(sparse, 3, 5.0, 4, 100)
    assert params.count() == 1 and params.first().val > 0


def test_factorisation_as_in_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(u, i, float(rng.integers(1, 5))) for u in range(6) for i in range(5) if (u + i) % 2 == 0]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    def error(n):
        return learning.rating_error(learning.predictions(ratings, *learning.factorise(ratings, 3, n, 2, 0.05, 0.0, start=1.0))).first().rmse

    assert error(12) < 0.7 * error(1)


@pytest.mark.parametrize("immediate", [True, False])
def test_factorisation_is_that_of_one_rating_after_another(spark, immediate):
    rng = np.random.default_rng(4)
    rows = sorted({(int(u), int(i)): float(rng.integers(1, 5)) for u, i in rng.integers(0, 30, (300, 2))}.items())
    ratings = spark.createDataFrame([(u, i, r) for (u, i), r in rows] + [(7, 99, None), (None, 3, 1.0)], "user long, item long, rating double").repartition(5)
    got = [{r[0]: r[1] for r in df.collect()} for df in learning.factorise(ratings, 3, 2, 3, 0.05, 0.01, immediate, 1.0)]
    p, q = [{r[0]: np.array(r[1]) for r in df.collect()} for df in learning.factorise(ratings, 3, 0, 3, 0.05, 0.01, immediate, 1.0)]
    assert set(p) == {u for (u, _), _ in rows} | {7} and 99 in q
    for n in range(6):
        for (u, i), r in rows:
            if i % 3 == (u % 3 + n) % 3:
                e = r - p[u] @ q[i]
                new = q[i] + 0.05 * (e * p[u] - 0.01 * q[i])
                p[u] = p[u] + 0.05 * (e * (new if immediate else q[i]) - 0.01 * p[u])
                q[i] = new
    for a, b in zip(got, (p, q)):
        assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in b)


def test_ratings_of_a_block_are_met_in_parts():
    rows = pa.RecordBatch.from_pydict({"block": [0, 0, 0, 0, 1], "kind": [1, 0, 0, 0, 0], "items": [None, [1, 2], [1, 2, 3], [2], [3, 4]]})
    assert [b.num_rows for b in learning._stretches(iter([rows]), 5)] == [1, 1, 2, 1] and [b.num_rows for b in learning._stretches(iter([rows]), 2)] == [1, 1, 1, 1, 1]


def test_links(spark):
    pages = spark.createDataFrame([("http://a.b/c/d?x", '<a href="/e">e</a><a class=y href="f">f</a><a href="https://g.h/">g</a><a href="//i.j">i</a>')], "url string, html string")
    assert sorted(r.dst for r in crawl.links_of(pages).collect()) == ["http://a.b/c/f", "http://a.b/e", "http://i.j", "https://g.h/"]
    seeds = spark.createDataFrame([("http://a.b/c/d?x",)], "url string")
    assert crawl.crawl(pages, seeds).count() == 5
    assert crawl.fetched(seeds, lambda u: [u + "/1", u + "/2"]).count() == 2


def test_relational(spark):
    a = spark.createDataFrame([("k", 5), ("k", 1), ("m", 5)], "k string, t int")
    b = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("k", 6, "z")], "k string, t int, v string")
    assert sorted((r.k, r.t, r.v) for r in relational.as_of(a, b, ["k"], "t", ["v"]).collect()) == sorted([("k", 5, "y"), ("k", 1, None), ("m", 5, None)], key=str)
    r = spark.createDataFrame([(0, 10, "a"), (7, 30, "b"), (5, 5, "none")], "lo int, hi int, n string")
    p = spark.createDataFrame([(7,), (10,), (30,), (5,)], "x int")
    assert sorted((q.x, q.n) for q in relational.interval_join(p, r, "x", "lo", "hi", 8).collect()) == [(5, "a"), (7, "a"), (7, "b"), (10, "b")]
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {q.k: q.v for q in relational.salted_sum(s, ["k"], "v").collect()} == {"a": 3, "b": 3}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:02:00"), (2, "2024-01-01 00:11:00")], "user long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: windows.source(spark, str(tmp_path / "in"), rows.schema)
    n = [F.count(F.lit(1)).alias("n")]
    got = windows.run_available(windows.tumbling(stream(), "ts", "10 minutes", [], n, "5 minutes"), "t_tumbling")
    assert sorted(r.n for r in got.collect()) == [1, 2]
    got = windows.run_available(windows.session_counts(stream(), "ts", "5 minutes", ["user"], n, "5 minutes"), "t_session")
    assert sorted((r.user, r.n) for r in got.collect()) == [(1, 2), (2, 1)]
    got = windows.run_available(windows.deduplicated(stream(), ["user"], "ts", "1 hour"), "t_dedup", "append")
    assert sorted(r.user for r in got.collect()) == [1, 2]
    got = windows.run_available(windows.fold_stream(stream(), ["user"], lambda old, rows: ((old[0] if old else 0) + len(rows),), "n long"), "t_fold", "update")
    assert sorted((r.user, r.n) for r in got.collect()) == [(1, 2), (2, 1)]
    windows.keep(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
