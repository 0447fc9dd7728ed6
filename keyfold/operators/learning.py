"""k-means, logistic regression and matrix factorisation.

What depends on how rows are dealt to partitions is defined by a logical partition, a column of the row's id, so it is
the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold import storage
from keyfold.functions import dot, sigmoid, squared_distance

# k-means


def pick_centres(points: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """The k points with the smallest digests of their ids; a fixed number of rows comes to the driver."""
    rows = points.select(F.md5(F.col(vec_id).cast("string").cast("binary")).alias("h"), vec_id, F.col(vector).cast("array<double>").alias("v")).orderBy("h", vec_id).limit(k).collect()
    return [list(r["v"]) for r in rows]


def nearest(centres: list[list[float]], vector: str = "embedding") -> Column:
    """A struct (d, c): squared distance to, and number of, the nearest centre; the first of equally near ones."""
    options = [F.struct(squared_distance(vector, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*options))


def nearest_of(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x, the number of the nearest row of middle, the first of equally near ones, and its squared distance.
    A matrix product picks candidates; where several are nearly as near, they are compared exactly."""
    rough = (x * x).sum(1)[:, None] - 2 * x @ middle.T + (middle * middle).sum(1)
    low = rough.min(1)
    row, col = np.nonzero(rough <= (low + 1e-6 * (1 + abs(low)))[:, None])
    exact = ((x[row] - middle[col]) ** 2).sum(1)
    order = np.lexsort((col, exact, row))
    first = order[np.searchsorted(row[order], np.arange(len(x)))]
    return col[first], exact[first]


def _vectors(rows: pd.DataFrame, size: int) -> np.ndarray:
    return np.array(rows["v"].tolist(), np.float64).reshape(len(rows), size)


def _sums(parts: DataFrame, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (c, n, s) of tasks to k sums of n and of s. Numbers of a vector are rows of the shuffle, so long vectors make no
    wide plan; k times size numbers come to the driver."""
    n, s = np.zeros(k), np.zeros((k, size))
    flat = parts.select("c", F.posexplode(F.concat(F.array("n"), "s")).alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).toArrow()
    c, i, x = (flat[name].to_numpy() for name in ("c", "i", "x"))
    n[c[i == 0]] = x[i == 0]
    s[c[i > 0], i[i > 0] - 1] = x[i > 0]
    return n, s


def assign(points: DataFrame, centres: list[list[float]], vec_id: str = "vec_id", vector: str = "embedding", cells: int = 20_000_000) -> DataFrame:
    """(vec_id, c, d). Batches of points meet all centres in a matrix product."""
    middle = np.array(centres, np.float64)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, cells // max(1, len(middle)))
        for rows in it:
            for at in range(0, len(rows), size):
                part = rows.iloc[at : at + size]
                c, d = nearest_of(_vectors(part, middle.shape[1]), middle)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "c": c.astype(np.int32), "d": d})

    rows = points.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, "id long, c int, d double").withColumnRenamed("id", vec_id)


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int, vec_id: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """Centres after so many rounds of assigning and averaging. A round leaves one partial sum per task and centre;
    centres without points stay."""
    rows = points.select(F.col(vector).cast("array<double>").alias("v"))
    middle = np.array(centres, np.float64)
    for _ in range(rounds):

        def partial(it: Iterator[pd.DataFrame], middle: np.ndarray = middle) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(middle), np.zeros(len(middle))
            for batch in it:
                for at in range(0, len(batch), 4096):
                    x = _vectors(batch.iloc[at : at + 4096], middle.shape[1])
                    c, _ = nearest_of(x, middle)
                    np.add.at(total, c, x)
                    count += np.bincount(c, minlength=len(middle))
            used = np.flatnonzero(count)
            if len(used):  # a frame without rows has no type for s
                yield pd.DataFrame({"c": used.astype(np.int32), "n": count[used], "s": list(total[used])})

        n, s = _sums(rows.mapInPandas(partial, "c int, n double, s array<double>"), middle.shape[1], len(middle))
        middle = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], middle)
    return [list(c) for c in middle.tolist()]


def mean_squared_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("d").alias("mse"), F.count(F.lit(1)).alias("n"))


def online_kmeans(
    points: DataFrame, centres: list[list[float]], rounds: int, parts: int, vec_id: str = "vec_id", vector: str = "embedding", alpha: float = 1.0, replicate: int = 1, every: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Centres and counts after rounds of online updates: each logical partition goes through its points by id, replicate
    times, on a copy of its own, and the changes of all partitions add up. Counts start at 1. A point moves its nearest
    centre by alpha over the centre's count, itself counted. every: of a partition's points only each so many-th counts, in
    the order in which all passes meet them.

    points: vec_id, and either arrays of numbers or sparse vectors as arrays of (i, v), i from 0; what a sparse vector lacks is
    0. A partition's points are held by its task if it goes through them several times, so parts should grow with the points.
    """
    middle, counts = np.array(centres, np.float64), np.ones(len(centres))
    size = middle.shape[1]
    sparse = "struct" in points.schema[vector].dataType.simpleString()
    v = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(vector), i).cast("double"), F.lit(0.0))) if sparse else F.col(vector).cast("array<double>")
    rows = points.select(F.pmod(F.col(vec_id), F.lit(parts)).cast("int").alias("p"), F.col(vec_id).alias("id"), v.alias("v"))
    rows = rows.repartition(parts, "p").sortWithinPartitions("p", "id")
    for _ in range(rounds):

        def change(it: Iterator[pd.DataFrame], middle: np.ndarray = middle, counts: np.ndarray = counts) -> Iterator[pd.DataFrame]:
            moved, seen = np.zeros_like(middle), np.zeros_like(counts)
            now = own = n = None
            held: list[np.ndarray] = []
            met = 0

            def see(x: np.ndarray) -> None:
                nonlocal met
                met += 1
                if met % every == 0:
                    c = int(((own - x) ** 2).sum(1).argmin())
                    n[c] += 1
                    own[c] -= alpha / n[c] * (own[c] - x)

            def end() -> None:
                nonlocal moved, seen
                for _ in range(replicate - 1):
                    for x in held:
                        see(x)
                moved, seen = moved + (own - middle), seen + (n - counts)

            for batch in it:
                for p, x in zip(batch["p"], _vectors(batch, size)):
                    if p != now:
                        if own is not None:
                            end()
                        now, own, n, held, met = p, middle.copy(), counts.copy(), [], 0
                    see(x)
                    if replicate > 1:
                        held.append(x)
            if own is not None:
                end()
            yield pd.DataFrame({"c": np.arange(len(middle), dtype=np.int32), "n": seen, "s": list(moved)})

        n, s = _sums(rows.mapInPandas(change, "c int, n double, s array<double>"), size, len(middle))
        middle, counts = middle + s, counts + n
    return middle, counts


# logistic regression


def margin(weights: list[float], features: list[str]) -> Column:
    """w.x + b; the intercept is the last weight."""
    return sum((F.lit(w) * F.col(f) for w, f in zip(weights, features)), F.lit(weights[-1]))


def dense_logistic(points: DataFrame, features: list[str], label: str, rounds: int, alpha: float, parts: int, key: str, weights: list[float] | None = None) -> list[float]:
    """Weights, intercept last. Each round adds the sum over logical partitions of their mean gradients times alpha.
    Labels under 0 count as 0. A round is one scan; a row per partition comes to the driver."""
    w = list(weights or [0.0] * (len(features) + 1))
    y = F.when(F.col(label) < 0, 0).otherwise(F.col(label))
    rows = points.select(*features, y.alias("_y"), F.pmod(F.col(key), F.lit(parts)).alias("_p"))
    for _ in range(rounds):
        e = F.col("_y") - sigmoid(margin(w, features))
        means = rows.groupBy("_p").agg(*(F.avg(F.col(f) * e).alias(f"g{i}") for i, f in enumerate(features)), F.avg(e).alias("gb"))
        g = means.agg(*(F.sum(f"g{i}") for i in range(len(features))), F.sum("gb")).first()
        w = [a + alpha * (b or 0.0) for a, b in zip(w, g)]
    return w


def dense_accuracy(points: DataFrame, features: list[str], label: str, weights: list[float]) -> DataFrame:
    right = (sigmoid(margin(weights, features)) >= 0.5) == (F.col(label) > 0)
    return points.agg(F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def sparse_margins(points: DataFrame, params: DataFrame, bias: float = 0.0) -> DataFrame:
    """(id, y, z) from points (id, y, x of (i, v)) and params (fea, val); features without a parameter count as 0."""
    terms = points.select("id", "y", F.explode_outer("x").alias("t")).select("id", "y", F.col("t.i").alias("fea"), F.col("t.v").alias("v"))
    return terms.join(params, "fea", "left").groupBy("id", "y").agg((F.sum(F.coalesce(F.col("v") * F.col("val"), F.lit(0.0))) + bias).alias("z"))


def sparse_step(points: DataFrame, params: DataFrame, alpha: float, batch: int) -> DataFrame:
    """params (fea, val) after a step: alpha / batch times the sum of x (y - sigmoid(w.x)). Only the keys that the
    points have are read and written; new ones come to be."""
    error = sparse_margins(points, params).select("id", (F.col("y") - sigmoid(F.col("z"))).alias("e"))
    terms = points.select("id", F.explode("x").alias("t")).select("id", F.col("t.i").alias("fea"), F.col("t.v").alias("v"))
    grad = terms.join(error, "id").groupBy("fea").agg((F.sum(F.col("v") * F.col("e")) * (alpha / batch)).alias("g"))
    return params.join(grad, "fea", "full_outer").select("fea", (F.coalesce("val", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("val"))


def prefix_batch(points: DataFrame, parts: int, per_part: int, key: str = "id") -> DataFrame:
    """The first points of each logical partition, by key: the same ones every round."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.pmod(F.col(key), F.lit(parts))).orderBy(key))
    return points.withColumn("_n", place).filter(F.col("_n") <= per_part).drop("_n")


def sparse_logistic(points: DataFrame, rounds: int, alpha: float, parts: int, batch: int) -> DataFrame:
    """Parameters after rounds of mini-batch steps without an intercept."""
    from keyfold.operators.iterate import iterate

    some = storage.cut(prefix_batch(points, parts, max(1, batch // parts)))
    start = some.sparkSession.createDataFrame([], "fea int, val double")
    out = iterate(start, lambda params, n: sparse_step(some, params, alpha, batch), rounds)
    return out


def full_logistic(points: DataFrame, rounds: int, alpha: float, parts: int, key: str = "id") -> tuple[DataFrame, float]:
    """Parameters (fea, val) and the intercept, from all points in every round: as in dense_logistic, a round adds the sum
    over logical partitions of their mean gradients times alpha. Labels under 0 count as 0. A round is one scan; a row
    per feature comes to the driver."""
    y = F.when(F.col("y") < 0, 0).otherwise(F.col("y")).cast("double").alias("y")
    rows = points.select(F.pmod(F.col(key), F.lit(parts)).cast("int").alias("p"), y, F.col("x.i").alias("i"), F.col("x.v").alias("v"))
    sizes = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("i")).alias("last")).collect()
    counts = np.ones(parts)
    for r in sizes:
        counts[r["p"]] = r["n"]
    w = np.zeros(max((r["last"] for r in sizes if r["last"] is not None), default=-1) + 2)
    for _ in range(rounds):

        def gradient(it: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(w)
            for b in it:
                fea, v = b.column("i").flatten().to_numpy(zero_copy_only=False), b.column("v").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), b.column("i").value_lengths().to_numpy(zero_copy_only=False))
                z = np.bincount(row, weights=v * w[fea], minlength=b.num_rows) + w[-1]
                e = (b.column("y").to_numpy() - 1 / (1 + np.exp(-z))) / counts[b.column("p").to_numpy()]
                total += np.bincount(fea, weights=v * e[row], minlength=len(w))
                total[-1] += e.sum()
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["fea", "g"])

        sums = rows.mapInArrow(gradient, "fea int, g double").groupBy("fea").agg(F.sum("g").alias("g")).collect()
        w = w.copy()
        for r in sums:
            w[r["fea"]] += alpha * r["g"]
    used = np.flatnonzero(w[:-1]).tolist()
    return points.sparkSession.createDataFrame([(i, float(w[i])) for i in used], "fea int, val double"), float(w[-1])


# matrix factorisation


def predictions(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, rating, predicted) from factors (user, p) and (item, q)."""
    return scored(ratings.join(users, "user").join(items, "item"))


def scored(ratings: DataFrame) -> DataFrame:
    """(user, item, rating, predicted) of ratings that have their factors p and q."""
    return ratings.select("user", "item", "rating", dot("p", "q").alias("predicted"))


def rating_error(predicted: DataFrame) -> DataFrame:
    d = F.col("rating") - F.col("predicted")
    return predicted.agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def _stretches(it: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, ..., items) in parts of one block and kind, of at most so many items and a row at least."""
    for b in it:
        both = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
        seen = np.cumsum(b.column("items").value_lengths().fill_null(0).to_numpy().astype(np.int64))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(both)) + 1, np.searchsorted(seen, np.arange(most, seen[-1] if len(seen) else 0, most)), [len(both)]))
        for lo, hi in pairwise(np.unique(cuts)):
            yield b.slice(lo, hi - lo)


def _descend(p: np.ndarray, q: np.ndarray, u: np.ndarray, i: np.ndarray, r: np.ndarray, rate: float, penalty: float, immediate: bool) -> None:
    """Steps of ratings r between p[u] and q[i], as if one after another. A step waits only for those before it with its user or
    item, so steps go in levels: of each level no two share a user or an item."""
    seen = ~np.isnan(r)  # a rating that is unknown teaches nothing
    u, i, r = u[seen], i[seen], r[seen]
    for now in _levels(u, i):
        a, b, at, to = p[u[now]], q[i[now]], u[now], i[now]
        e = (r[now] - (a * b).sum(1))[:, None]
        new = b + rate * (e * a - penalty * b)
        p[at] = a + rate * (e * (new if immediate else b) - penalty * a)
        q[to] = new


def _levels(u: np.ndarray, i: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of steps, level by level: each comes after all earlier steps with the same u or i."""
    n = len(u)
    waits, after = np.zeros(n, np.int8), np.full((2, n), n, np.int64)
    for k, key in enumerate((u, i)):
        order = np.argsort(key, kind="stable")
        before, later = order[:-1], order[1:]
        same = key[before] == key[later]
        after[k, before[same]] = later[same]
        waits[later[same]] += 1
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        yield ready
        nxt = after[:, ready].ravel()
        nxt = nxt[nxt < n]
        np.subtract.at(waits, nxt, 1)
        ready = np.unique(nxt[waits[nxt] == 0])


def factorise(ratings: DataFrame, rank: int, rounds: int, blocks: int, rate: float, penalty: float, immediate: bool = True, start: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """User and item factors by stochastic gradient descent over a ring of blocks.

    Users stay in block user % blocks; in each of a round's stretches, block b meets the items of block (b + stretch)
    % blocks, so no two tasks ever change the same factors. immediate: an item's new factor is used for the user's.
    A task holds the factors of a block of items. Its users come one after another, each with its ratings as a row, and
    some at a time, so neither users nor ratings are held.
    """
    from keyfold.operators.iterate import iterate

    rows = ratings.select(F.col("user").cast("long"), F.col("item").cast("long"), F.col("rating").cast("double")).filter("user is not null and item is not null")
    ib = F.pmod("item", F.lit(blocks)).cast("int").alias("ib")
    rows = storage.cut(rows.groupBy("user", ib).agg(F.array_sort(F.collect_list(F.struct("item", "rating"))).alias("r")).select("user", "ib", F.col("r.item").alias("items"), F.col("r.rating").alias("ratings")))
    seed = lambda kind, c: F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda i: F.pmod(F.xxhash64(F.lit(kind), c, i), F.lit(1000)) / 1000.0 * start)
    users = rows.select("user").distinct().select(F.lit(0).alias("kind"), F.col("user").alias("id"), seed("u", F.col("user")).alias("f"))
    items = rows.select(F.explode("items").alias("item")).distinct().select(F.lit(1).alias("kind"), F.col("item").alias("id"), seed("i", F.col("item")).alias("f"))

    def train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "f"]
        ids, q, now, block_ids, block_q = np.zeros(0, np.int64), np.zeros((0, rank)), None, [], []

        def factors(ids: np.ndarray, f: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), 50_000):
                n = len(part := ids[at : at + 50_000])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(f[at : at + n].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(part), lists], names=names)

        for b in _stretches(it):
            block, kind = b.column("block")[0].as_py(), b.column("kind")[0].as_py()
            if block != now:
                yield from factors(ids, q, 1)
                now, block_ids, block_q = block, [], []
                ids, q = np.zeros(0, np.int64), np.zeros((0, rank))
            if kind == 1:  # items come first, by id
                block_ids.append(b.column("id").to_numpy())
                block_q.append(b.column("f").flatten().to_numpy().reshape(-1, rank))
                continue
            if block_ids:
                ids, q, block_ids, block_q = np.concatenate(block_ids), np.concatenate(block_q), [], []
            own, p = b.column("id").to_numpy(), b.column("f").flatten().to_numpy().reshape(-1, rank).copy()
            n = b.column("items").value_lengths().fill_null(0).to_numpy()
            _descend(p, q, np.repeat(np.arange(len(own)), n), np.searchsorted(ids, b.column("items").flatten().to_numpy()), b.column("ratings").flatten().to_numpy(zero_copy_only=False), rate, penalty, immediate)
            yield from factors(own, p, 0)
        if block_ids:
            ids, q = np.concatenate(block_ids), np.concatenate(block_q)
        yield from factors(ids, q, 1)

    def stretch(state: DataFrame, n: int) -> DataFrame:
        shift = (n - 1) % blocks
        block = F.when(F.col("kind") == 0, F.pmod("id", F.lit(blocks))).otherwise(F.pmod(F.pmod("id", F.lit(blocks)) - shift, F.lit(blocks))).cast("int")
        here = rows.filter(F.col("ib") == F.pmod(F.pmod("user", F.lit(blocks)) + shift, F.lit(blocks))).select(F.lit(0).alias("k"), "user", "items", "ratings")
        met = state.join(here, (F.col("kind") == F.col("k")) & (F.col("id") == F.col("user")), "left").select(block.alias("block"), "kind", "id", "f", "items", "ratings")
        return met.repartition("block").sortWithinPartitions("block", F.desc("kind"), "id").mapInArrow(train, "kind int, id long, f array<double>")

    out = iterate(users.union(items), stretch, rounds * blocks, checkpoint_every=4)
    return out.filter("kind = 0").select(F.col("id").alias("user"), F.col("f").alias("p")), out.filter("kind = 1").select(F.col("id").alias("item"), F.col("f").alias("q"))
