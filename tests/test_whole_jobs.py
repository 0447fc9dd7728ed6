"""Queries that have to read all of their input, against brute force."""

import numpy as np

from keyfold.operators import learning
from keyfold.queries import QUERIES
from keyfold.queries import learning as learning_queries
from keyfold.sources.tables import order_edges

FOLDER = "/root/testdata/sf0.001"


def test_closure_goes_over_all_edges(spark):
    after = {}
    for r in order_edges(spark, FOLDER).collect():
        after.setdefault(r.src, []).append(r.dst)
    seen, now = {1, 50, 100}, [1, 50, 100]
    while now:
        now = list({v for u in now for v in after.get(u, ())} - seen)
        seen |= set(now)
    got = QUERIES["reachable_closure"](spark, FOLDER).collect()
    assert sorted((r.vertex, r.status) for r in got) == [(v, "Done") for v in sorted(seen)]


def test_documents_regression_reads_all_points(spark):
    points = learning_queries._sparse_points(spark, FOLDER)
    rows = points.collect()
    x, y, part = np.zeros((len(rows), 513)), np.array([max(r.y, 0) for r in rows], float), np.array([r.id % 4 for r in rows])
    x[:, -1] = 1
    for n, r in enumerate(rows):
        for t in r.x:
            x[n, t.i] = t.v
    w = np.zeros(513)
    for _ in range(5):
        e = y - 1 / (1 + np.exp(-x @ w))
        w = w + 0.5 * sum(x[part == p].T @ e[part == p] / (part == p).sum() for p in np.unique(part))
    params, bias = learning.full_logistic(points, 5, 0.5, 4)
    got = np.zeros(512)
    for r in params.collect():
        got[r.fea] = r.val
    assert np.allclose(got, w[:-1]) and np.isclose(bias, w[-1]) and bias != 0
    out = QUERIES["tfidf_lr"](spark, FOLDER).first()
    assert out.n == len(rows) and np.isclose(out.accuracy, ((x @ w >= 0) == (y > 0)).mean())


def test_points_beyond_a_prefix_count(spark):
    rows = [(i, 0 if i < 240 else 1, [(0, 1.0)] if i < 240 else [(1, 1.0)]) for i in range(480)]
    points = spark.createDataFrame(rows, "id long, y int, x array<struct<i:int,v:double>>")
    params, bias = learning.full_logistic(points, 20, 0.5, 4)
    z = learning.sparse_margins(points, params, bias)
    assert z.filter("(z >= 0) <> (y > 0)").count() == 0


def test_lloyd_where_tasks_have_no_points(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [9.0, 9.0])], "vec_id long, embedding array<float>").repartition(8)
    assert learning.lloyd(points, [[1.0, 2.0], [8.0, 8.0], [99.0, 99.0]], 2) == [[2.0, 3.0], [9.0, 9.0], [99.0, 99.0]]
    assert learning.lloyd(points.filter("vec_id > 3"), [[1.0, 2.0]], 1) == [[1.0, 2.0]]


def test_factors_that_follow_from_ids_join_nothing(spark):
    plan = QUERIES["mf_eval_rmse"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # lines with their orders
