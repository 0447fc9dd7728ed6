"""The primitive, folds, pipelines, partitioning, iteration and recovery."""

import pytest
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.operators import map_update as mu
from keyfold.operators import partitioning
from keyfold.operators.folds import Append, Count, Ignore, Max, Min, Overwrite, PythonFold, SetAdd, Sum, TopK, VectorSum
from keyfold.operators.iterate import iterate, repeated, resume
from keyfold.plans import Dag, Pipeline

LETTERS = list("banana")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def ones(df):
    return df.select("word", F.lit(1).alias("msg"))


@pytest.fixture()
def letters(spark):
    return spark.createDataFrame([(x,) for x in LETTERS], "word string")


def test_counts_by_sum(letters):
    assert as_dict(mu.map_update(letters, None, ("word",), ones, {"n": Sum()}), "word", "n") == {"a": 3, "n": 2, "b": 1}


def test_messages_are_folded_whatever_their_order(spark):
    rows = spark.createDataFrame([(3, 1), (2, 1), (2, 1), (3, 3), (3, 2)], "k int, msg int")
    assert as_dict(mu.fold_messages(rows, None, ("k",), {"s": Sum()}), "k", "s") == {2: 2, 3: 6}


def test_every_element_gives_its_message(spark):
    rows = spark.createDataFrame([(10, 5), (20, 6)], "a int, b int")
    assert sorted(map(tuple, rows.select("a", F.lit(1)).collect())) == [(10, 1), (20, 1)]


def test_lookup_finds_equal_keys_only(spark):
    table = spark.createDataFrame([(1, 2), (5, 3), (3, 4), (6, 6)], "k int, v int")
    keys = spark.createDataFrame([(5,), (2,), (11,), (5,), (None,)], "k int")
    assert as_dict(mu.lookup(keys, table, ("k",), {"v": 0}), "k", "v") == {5: 3, 2: 0, 11: 0}
    assert table.count() == 4


def test_rounds_over_the_same_input_add_up(letters):
    out = repeated(None, lambda s: mu.map_update(letters, s, ("word",), ones, {"n": Sum()}, {"n": 0}), 10)
    assert as_dict(out, "word", "n") == {"a": 30, "n": 20, "b": 10}


def test_new_keys_start_from_defaults(spark):
    state = spark.createDataFrame([("a", 5, "x")], "k string, n int, note string")
    msgs = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, msg int")
    out = mu.fold_messages(msgs, state, ("k",), {"n": Sum()}, {"n": 100, "note": "new"})
    assert sorted(map(tuple, out.collect())) == [("a", 6, "x"), ("b", 102, "new")]


def test_unknown_columns_and_keys_are_told(spark):
    state = spark.createDataFrame([("a", 5)], "k string, n int")
    msgs = spark.createDataFrame([("b", 1)], "k string, msg int")
    with pytest.raises(ValueError):
        mu.fold_messages(msgs, state, ("k",), {"m": Sum()})
    with pytest.raises(ValueError):
        mu.fold_messages(msgs.drop("k"), state, ("k",), {"n": Sum()})
    with pytest.raises(Exception, match="out of range"):
        mu.fold_messages(msgs, state, ("k",), {"n": Sum()}, existing_only=True).collect()


def test_folds_with_state(spark):
    state = spark.createDataFrame([(1, 5, 5, [9], ["a"], [8, 7], [1.0, 1.0], "old", 3)], "k int, lo int, hi int, l array<int>, s array<string>, t array<int>, v array<double>, o string, c long")
    msgs = spark.createDataFrame([(1, 3, "b", [1.0, 2.0]), (1, 9, "a", [0.5, 0.5])], "k int, x int, y string, z array<double>")
    folds = {"lo": Min("x"), "hi": Max("x"), "l": Append("x"), "s": SetAdd("y"), "t": TopK("x", 2), "v": VectorSum("z", 2), "o": Overwrite("y", "x"), "c": Count()}
    row = mu.fold_messages(msgs, state, ("k",), folds).first()
    assert (row.lo, row.hi, row.l, row.s, row.t, row.v, row.o, row.c) == (3, 9, [3, 9, 9], ["a", "b"], [9, 8], [2.5, 3.5], "a", 5)


def test_ignored_messages_make_keys(spark):
    msgs = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(r.k for r in mu.fold_messages(msgs, None, ("k",), {"_": Ignore()}).collect()) == [1, 2]


def test_python_fold(spark):
    msgs = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 9)], "k string, at int, msg int")
    state = spark.createDataFrame([("a", "0"), ("c", "7")], "k string, log string")

    def fold(old, rows):
        return {"k": rows["k"].iloc[0], "log": (old["log"] if old else "") + "".join(map(str, rows["msg"]))}

    out = mu.fold_messages(msgs, state, ("k",), PythonFold(fold, ("at",)), schema="k string, log string")
    assert as_dict(out, "k", "log") == {"a": "012", "b": "9", "c": "7"}
    assert as_dict(mu.fold_messages(msgs, None, ("k",), PythonFold(fold, ("at",)), schema="k string, log string"), "k", "log") == {"a": "12", "b": "9"}


def test_mappers_from_python(spark, letters):
    flat = mu.flat_map(lambda row: [(row["word"], 1), (row["word"] + "!", 1)], "word string, msg int")
    assert as_dict(mu.map_update(letters, None, ("word",), flat, {"n": Sum()}), "word", "n") == {"a": 3, "n": 2, "b": 1, "a!": 3, "n!": 2, "b!": 1}

    def whole(it):
        import pandas as pd

        yield pd.DataFrame({"k": ["n"], "msg": [sum(len(b) for b in it)]})

    assert as_dict(mu.map_update(letters, None, ("k",), mu.partition_map(whole, "k string, msg int"), {"n": Sum()}), "k", "n") == {"n": 6}


def test_side_collection(spark, letters):
    side = spark.createDataFrame([("a", 10), ("n", 20)], "word string, w int")
    mapper = lambda a, b: a.join(b, "word").select("word", F.col("w").alias("msg"))
    for bound in (None, 1, 100):
        assert as_dict(mu.map_with_update(letters, side, None, ("word",), mapper, {"n": Sum()}, broadcast_rows=bound), "word", "n") == {"a": 30, "n": 40}


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("mode", ["none", "direct", "shuffle", 500])
@pytest.mark.parametrize("runner", ["sequential", "wide"])
def test_pipeline_result_depends_on_none_of_its_settings(spark, parts, mode, runner):
    p = Pipeline(spark, runner)
    words = p.distribute(LETTERS, "word string", parts)
    counts = p.placeholder("word string, n long", ["word"], parts, defaults={"n": 0})
    p.map_update(words, counts, ones, {"n": Sum()}).set_combine(mode).set_iter(2).set_staleness(1)
    assert as_dict(p.run().collections[1].frame(), "word", "n") == {"a": 6, "n": 4, "b": 2}
    assert counts.version == 2


def test_distribute_deals_in_turn(spark):
    p = Pipeline(spark)
    c = p.distribute(range(5), "x int", 2)
    p.run()
    got = {}
    for r in c.frame().select("x", F.spark_partition_id().alias("p")).collect():
        got.setdefault(r.p, set()).add(r.x)
    assert sorted(map(sorted, got.values())) == [[0, 2, 4], [1, 3]]


def test_distribute_by_key_and_dense_ranges(spark):
    p = Pipeline(spark)
    c = p.distribute_by_key([("a", 1), ("b", 2), ("a", 3)], "k string, v int", ["k"], 2)
    dense = p.range_placeholder(4, "key long, n int", defaults={"n": 0})
    p.map_update(c, dense, lambda df: df.select(F.col("v").cast("long").alias("key"), F.lit(1).alias("msg")), {"n": Sum()})
    n = p.count(dense)
    p.sort_each_partition(dense)
    p.run()
    assert as_dict(c.frame(), "k", "v") == {"a": 3, "b": 2}
    assert as_dict(dense.frame(), "key", "n") == {0: 0, 1: 0, 2: 1, 3: 1}
    assert n.result == 4


def test_pipeline_runs_only_what_is_needed(spark):
    p = Pipeline(spark)
    a, b = p.distribute([1], "x int"), p.distribute([2], "x int")
    p.run(a)
    assert a.df is not None and b.df is None
    p.run()
    assert b.frame().count() == 1
    assert "distribute" in p.dag.debug_string() and len(p.plans) == 2


def test_foreach_write_and_checkpoints(spark, tmp_path):
    p = Pipeline(spark)
    c = p.distribute([("x", 1), ("y", 2)], "k string, n int", 2)
    seen = spark.sparkContext.accumulator(0)
    p.foreach(c, lambda r: seen.add(r["n"]))
    p.write(c, str(tmp_path / "out"), lambda df: df.select(F.format_string("%s %d", "k", "n")))
    p.checkpoint(c, str(tmp_path / "cp"))
    p.load_checkpoint(c)
    p.run()
    assert seen.value == 3
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x 1", "y 2"]
    assert as_dict(c.frame(), "k", "n") == {"x": 1, "y": 2}


def test_dag_orders_reads_and_writes():
    d = Dag()
    d.add(0, "w0", [], [0])
    d.add(1, "w1", [], [1])
    d.add(2, "r0w1", [0], [1])
    d.add(3, "w0 again", [], [0])
    assert d.before == {0: set(), 1: set(), 2: {0, 1}, 3: {0, 2}}
    assert d.levels() == [[0, 1], [2], [3]] and d.needed([2]) == {0, 1, 2}


def test_partitionings(spark):
    keys = spark.createDataFrame([(7,), (0,), (3,), (8,)], "k int")
    assert as_dict(keys.select("k", partitioning.ranges([(0, 3), (3, 6), (6, 9)]).column(("k",)).alias("p")), "k", "p") == {7: 2, 0: 0, 3: 1, 8: 2}
    assert as_dict(keys.select("k", partitioning.round_robin(3).column(("k",)).alias("p")), "k", "p") == {7: 1, 0: 0, 3: 0, 8: 2}
    for bad in ([(0, 3), (4, 6)], [(0, 3), (3, 5), (5, 8)], [(0, 0)], []):
        with pytest.raises(ValueError):
            partitioning.ranges(bad)
    own = partitioning.custom(2, lambda k: F.pmod(k, F.lit(2)))
    assert own.apply(keys, ("k",)).count() == 4 and partitioning.hashed(3).apply(keys, ()).rdd.getNumPartitions() == 3


def test_rounds_checkpoints_and_resume(spark, tmp_path):
    start = lambda: spark.createDataFrame([(0, 0), (1, 0)], "k int, n int")
    step = lambda df, n: df.select("k", (F.col("n") + 1).alias("n"))
    path = str(tmp_path / "rounds")
    assert as_dict(iterate(start(), step, 10, checkpoint_every=2, checkpoint_path=path), "k", "n") == {0: 10, 1: 10}
    assert storage.versions(spark, path) == [1, 2, 3, 4, 5]
    assert as_dict(resume(spark, step, 13, 2, path, start), "k", "n") == {0: 13, 1: 13}
    assert as_dict(resume(spark, step, 3, 2, str(tmp_path / "none"), start), "k", "n") == {0: 3, 1: 3}
    assert as_dict(iterate(start(), step, 0), "k", "n") == {0: 0, 1: 0}
    assert iterate(start(), step, 50, until=lambda a, b: b.first().n >= 4).first().n == 4
    with pytest.raises(ValueError):
        iterate(start(), step, -1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "word string")
    assert mu.map_update(none, None, ("word",), ones, {"n": Sum()}).count() == 0
    p = Pipeline(spark)
    c = p.placeholder("word string, n long", ["word"])
    p.map_update(p.collection("none", none), c, ones, {"n": Sum()}).set_iter(0)
    assert p.run().collections[0].frame().count() == 0
