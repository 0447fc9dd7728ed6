"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in an order shuffled by a hash of their ids and texts. Going round that order up to `epochs`
times, each copy's virtual finish time is its source's words up to and with it, divided by the source's target. All
copies, ordered by finish time, are taken while their words fit the total budget, so sources advance side by side and
end near their targets.

Only DataFrame functions run here, over narrow rows (id, source, words): texts are read once, for their sizes. Running
sums of a source are those of hash-range buckets plus the sums before the bucket, so a source with a third of all rows
is split over many tasks; so are the rows of one key, if there are very many. The order by finish time is ranged into slots, of about equal weight as time advances at the
same rate everywhere; sums of slots tell which slot the budget ends in, and only that one is sorted.

Targets: sources ordered by code point, null last, weigh 1, 2, 3 in turn and share all words; a target stops at
`epochs` times its source's words, and what is over is shared again by weight until none is above.

Defined results: a null text has no words; documents without words are never taken; a null source is a source of its
own, the last; rows that repeat a source, id and text, with or without an id, stand one after another, and the mix may end
between them: how many of them it takes, and how often, is the same in every run; an empty table gives no rows. The shuffle has no seed but `salt`, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.common import WORD_CLASS, freed_but, join_small, materialise

#: Documents in a hash-range bucket of a source, about: what one window holds.
BUCKET = 1000
#: Times BUCKET from which a bucket is looked through for a key with very many rows.
CROWDED = 8
#: Documents whose copies are in a slot of finish times, about: what is sorted at the end of the budget.
SLOT = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def shuffle_key(doc_id: Column, text: Column, salt: str) -> Column:
    of_id = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(of_id, F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """A row per source: source, rank, n_docs, source_size, target. The windows hold a row per source, no documents."""
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = sources.withColumn("rank", rank).withColumn("weight", weight.cast("long")).withColumn("most", epochs * F.col("source_size"))
    out = out.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("level", level).withColumn("capped", F.col("level") > F.col("ratio"))
    share = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return out.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share * F.col("weight"))).select("source", "rank", "n_docs", "source_size", "target")


def queued(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with its source's columns and cum, the source's words up to and with the row in shuffled order. Rows with one
    key are the same in all that counts here, so it doesn't matter which of them comes first."""
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * F.ceil(F.col("n_docs") / BUCKET))
    rows = join_small(sized.withColumn("_s", F.struct("source")), targets.withColumn("_s", F.struct("source")).drop("source"), ["_s"]).withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select("rank", "bucket", "n", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")), "buckets")
    within = Window.partitionBy("rank", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join_small(rows, sums.drop("n"), ["rank", "bucket"])
    crowded = sums.filter(F.col("n") > CROWDED * BUCKET).select("rank", "bucket")
    if not crowded.limit(1).count():
        return placed.withColumn("cum", F.col("before") + F.sum("size").over(within)).drop("_s", "bucket", "before", "part")
    # a key of very many rows is one row of its bucket's window, and its rows are numbered part by part
    same = placed.join(crowded, ["rank", "bucket"], "left_semi").groupBy("rank", "bucket", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    same = materialise(same, "same")
    heavy = materialise(same.groupBy("rank", "bucket", "key").agg(F.sum("n").alias("rows")).filter(F.col("rows") > BUCKET), "heavy")
    parts = Window.partitionBy("rank", "bucket", "key").orderBy("part")
    offsets = materialise(same.join(heavy, ["rank", "bucket", "key"]).select("rank", "bucket", "key", "part", (F.sum("n").over(parts) - F.col("n")).alias("offset")), "offsets")
    columns = placed.columns
    light = placed.join(heavy.select("rank", "bucket", "key"), ["rank", "bucket", "key"], "left_anti").select(*columns, F.lit(None).cast("long").alias("rows"))
    one = placed.join(heavy, ["rank", "bucket", "key"]).groupBy("rank", "bucket", "key").agg(*(F.first(c).alias(c) for c in columns if c not in ("rank", "bucket", "key")), F.first("rows").alias("rows"))
    weight = F.col("size") * F.coalesce("rows", F.lit(1))
    ends = light.unionByName(one).withColumn("cum", F.col("before") + F.sum(weight).over(within))
    base = materialise(ends.filter("rows is not null").select("rank", "bucket", "key", (F.col("cum") - F.col("size") * F.col("rows")).alias("base")), "bases")
    number = F.row_number().over(Window.partitionBy("rank", "bucket", "key", "part").orderBy(F.lit(0)))
    many = placed.join(offsets, ["rank", "bucket", "key", "part"]).join(base, ["rank", "bucket", "key"])
    many = many.withColumn("cum", F.col("base") + F.col("size") * (F.col("offset") + number)).select(*columns, "cum")
    return ends.filter("rows is null").select(*columns, "cum").union(many).drop("_s", "bucket", "before", "part")


def finish(epoch: Column) -> Column:
    return (F.col("cum") + epoch * F.col("source_size")) / F.col("target")


def mixed(sized: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sized, a materialised table with source, size and key, with rank, source_size, target and copies."""
    targets = materialise(source_targets(sized, weights, epochs), "targets")
    rows = materialise(queued(sized, targets), "queued")
    budget, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    k = -(-n // SLOT) or 1
    slot = lambda f: F.when(f < 2, F.floor(f * k)).otherwise(2 * k + F.floor(F.log2(f) * 16)).cast("long")
    copies = rows.filter("size > 0").select("rank", "cum", "size", F.explode(F.array(*(F.struct(F.lit(e).alias("e"), finish(F.lit(e)).alias("f")) for e in range(epochs)))).alias("c"))
    copies = copies.select("rank", "cum", "size", F.col("c.e").alias("e"), F.col("c.f").alias("f"), slot(F.col("c.f")).alias("slot"))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    order = Window.orderBy("slot")
    sums = slots.select("slot", "words", (F.sum("words").over(order) - F.col("words")).alias("before")).filter(F.col("before") + F.col("words") > budget)
    last = sums.orderBy("slot").select("slot", "before").first()
    if last is None:  # no words at all
        return rows.withColumn("copies", F.lit(0).cast("long"))
    place = ["f", "rank", "cum", "e"]  # of a copy: no two are the same
    run = F.sum("size").over(Window.partitionBy("slot").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = copies.filter(F.col("slot") == last["slot"]).withColumn("run", run + last["before"]).filter(F.col("run") <= budget)
    cut = fits.agg(F.max(F.struct(*place)).alias("cut")).first()["cut"]

    def takes(e: int) -> Column:
        f = finish(F.lit(e))
        inside = F.lit(False)
        if cut is not None:
            inside = F.struct(f.alias("f"), "rank", "cum", F.lit(e).alias("e")) <= F.struct(F.lit(cut["f"]).alias("f"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["cum"]).alias("cum"), F.lit(cut["e"]).alias("e"))
        return F.when(F.col("size") == 0, 0).when((slot(f) < last["slot"]) | ((slot(f) == last["slot"]) & inside), 1).otherwise(0)

    return rows.withColumn("copies", sum((takes(e) for e in range(1, epochs)), takes(0)).cast("long"))


def sized_rows(docs: DataFrame, salt: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffle_key(F.col(doc_id), F.col(text), salt).alias("key"), F.spark_partition_id().alias("part"))
    return materialise(rows, "sized")


def mix(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), salt: str = "mix:", **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and finish, the virtual finish time of its first
    copy, null for one without words."""
    out = mixed(sized_rows(docs, salt, **columns), epochs, weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("size") > 0, finish(F.lit(0))).alias("finish"))


def take_mixed(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), salt: str = "mix:") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    In each round of a source the taken documents are those up to a place in its order, so a row per source with the
    last key of each round is all that rows need to meet; texts aren't shuffled. Only where the mix ends between rows of
    one key, these go by their number, which is that of any one among them.
    """
    columns = docs.columns
    keep: list[DataFrame] = []
    with freed_but(keep):
        taken = materialise(mixed(sized_rows(docs, salt), epochs, weights).select("source", "key", "copies"), "taken")
        source = F.struct("source").alias("_s")
        last = materialise(taken.filter("copies > 0").groupBy(source).agg(*(F.max(F.when(F.col("copies") > e, F.col("key"))).alias(f"_last{e}") for e in range(epochs))), "places")
        # keys of which some rows are taken more often than others
        cut = taken.groupBy(source, F.col("key").alias("_key")).agg(F.sum("copies").alias("_sum"), F.min("copies").alias("_min"), F.max("copies").alias("_max")).filter("_min <> _max")
        cut = materialise(cut.select("_s", "_key", "_sum"), "cut")
        keep += [last, cut]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.struct(F.col("source").alias("source")).alias("_s"), shuffle_key(F.col("doc_id"), F.col("text"), salt).alias("_key"), word_count(F.col("text")).alias("_size"))
    rows = join_small(rows, last, ["_s"], "inner")
    n = sum((F.when(F.col("_key") <= F.col(f"_last{e}"), 1).otherwise(0) for e in range(1, epochs)), F.when(F.col("_key") <= F.col("_last0"), 1).otherwise(0))
    copies = F.when(F.col("_size") > 0, n).otherwise(0)
    if cut.limit(1).count():  # at most a key of each source in each round
        some = rows.join(F.broadcast(cut), ["_s", "_key"], "inner").groupBy("_s", "_key").agg(F.max("_sum").alias("_sum"), F.first("_row").alias("_row"))
        some = some.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_sum").cast("int")))).select("_row.*")
        rows = rows.join(F.broadcast(cut.select("_s", "_key")), ["_s", "_key"], "left_anti")
        return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*").union(some)
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
