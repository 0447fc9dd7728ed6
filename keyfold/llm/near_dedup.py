"""Near-duplicates by an LSH forest.

Texts become sets of word shingles (64-bit hashes), and equal sets one class. A class has a MinHash signature; each
tree of the forest is the order of all classes by a stretch of `DEPTH` values of it. Trees are range-partitioned and
sorted, so that the longest common prefixes are between neighbours, and read in one go: classes with a common prefix of
two values are a region. A region keeps leaders, to which its members are compared by their whole signatures; where
leaders crowd, the region goes one value deeper and leaves behind those with another prefix. Members become candidates
of their leader, and leaders of each other, if enough of their signatures agree. As a tree's partitions end anywhere,
the leaders of the regions at their ends meet in further, small steps: those of `FAN` partitions next to each other, then
those that these leave, until each region is whole.

Candidates only say which classes may be linked at all: their connected groups. Links are confirmed on the full sets,
within each group: every pair that may reach the threshold is compared exactly, unless its classes are linked already. A
group with more than `MEMBERS` classes or `GROUP` shingles is dealt into blocks. Each block is linked in itself, and
leaves a representative of each part that it falls into; representatives are dealt into blocks in the same way, until one
block holds those of a group or a pass joins none. Only where a group is in several parts even then, blocks meet: those
of its largest part meet the blocks of all the rest, and the rest's blocks each other. So copies of one text, however many,
cost one comparison with their block and a few of representatives. No step emits the pairs of a group, and there is no
cap on members or partners.

A pair at the threshold of 0.85 is in no common region with a chance of 0.28 ** 12, some 2e-7, where regions aren't
crowded.

Defined results: with fewer words than a shingle has, the whole sequence is one shingle; null texts and those without
words are linked with nothing. Rows are linked by their texts, so repeated ones share a component and a verdict; a
missing id comes after all others. A class is known by a 64-bit hash of its set, so texts that share an id or lack one
are told apart; the smallest id of a component is taken at the end. Long texts are read whole; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import ASCII_LOWER, batches, freed_but, join_small, materialise, one_of_each, partition_id
from keyfold.llm.components import UnionFind, components

TREES, DEPTH = 12, 4
SLOTS = TREES * DEPTH
#: Equal values of the signature: from which a class joins a leader, and from which two may be linked.
NEAR, MAYBE = 36, 24
#: Leaders of a region from which it goes deeper.
CROWD = 256
#: Neighbouring stretches of a region whose leaders meet in one task.
FAN = 8
#: Shingles and classes of a group, or of a block of a larger one, that are compared in one task, about.
GROUP, MEMBERS = 100_000, 250
NO_ID = 2**63 - 1
CACHE_WORDS = 200_000

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    from xxhash import xxh3_64_intdigest

    words = [t.translate(ASCII_LOWER).split() if t else [] for t in texts]
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in set().union(*words) - _words.keys():
        _words[w] = xxh3_64_intdigest(w)
    flat = np.fromiter((_words[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))
    n = max(0, len(flat) - size + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows += flat[k : k + n] * PLACES[k]
    windows = mixed(windows)
    out, at = [], 0
    for ws in words:
        m = len(ws)
        if m >= size:
            out.append(np.unique(windows[at : at + m - size + 1]))
        elif m:
            whole = (flat[at : at + m] * PLACES[:m]).sum(dtype=np.uint64) + np.uint64(m)
            out.append(mixed(np.array([whole], np.uint64) * PLACES[size]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SLOTS) of 32-bit minima; sets aren't empty."""
    out = np.empty((len(sets), SLOTS), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for j in range(SLOTS):
        out[:, j] = np.minimum.reduceat(((flat ^ MASKS[j]) * MULTIPLIERS[j]) >> np.uint64(32), starts)
    return out


FEATURES = "doc_id long, mark long, n_shingles long, set_key binary, slots binary, sig binary"


def features(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches(it, 2000, 2 << 20):
        ids = b.column("doc_id").to_pylist()
        sets = shingle_sets(b.column("text").to_pylist(), size)
        full = [i for i, s in enumerate(sets) if len(s)]
        slots = signatures([sets[i] for i in full])
        keys, values, short = [b"-%d" % i for i in ids], [b""] * len(ids), [b""] * len(ids)
        for row, i in enumerate(full):
            keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            values[i] = slots[row].astype(">u4").tobytes()
            short[i] = slots[row].astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), b.column("mark"), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(short, pa.binary())],
            names=["doc_id", "mark", "n_shingles", "set_key", "slots", "sig"],
        )
    _words.clear()


class Region:
    """Leaders of classes that share a prefix. added: all that ever were, if they are to be kept."""

    def __init__(self, keep: bool = False) -> None:
        self.added: list[tuple[int, bytes, bytes]] | None = [] if keep else None
        self.ids: list[int] = []
        self.prefixes: list[bytes] = []
        self.sig = np.zeros((64, SLOTS), np.uint8)
        self.sets = UnionFind()
        self.depth = 2

    def add_leader(self, doc: int, key: bytes, sig: np.ndarray) -> None:
        if len(self.ids) == len(self.sig):
            self.sig = np.concatenate([self.sig, np.zeros_like(self.sig)])
        self.sig[len(self.ids)] = sig
        self.ids.append(doc)
        self.prefixes.append(key)
        if self.added is not None:
            self.added.append((doc, key, sig.tobytes()))

    def deeper(self, key: bytes) -> None:
        """Where leaders crowd, those go that don't share a longer prefix with what comes."""
        while len(self.ids) >= CROWD and self.depth < DEPTH:
            self.depth += 1
            self.drop(key)

    def drop(self, key: bytes) -> None:
        n = 4 * self.depth
        keep = [i for i, p in enumerate(self.prefixes) if p[:n] == key[:n]]
        self.sig[: len(keep)] = self.sig[keep]
        self.ids, self.prefixes = [self.ids[i] for i in keep], [self.prefixes[i] for i in keep]

    def take(self, ids: list[int], keys: list[bytes], sig: np.ndarray) -> None:
        """The next classes, in the tree's order."""
        at = 0
        while at < len(ids):
            if self.depth > 2:
                self.drop(keys[at])
            self.deeper(keys[at])
            stop = at + 1 if not self.ids else min(len(ids), at + max(1, 40_000 // len(self.ids)))
            if self.depth > 2:
                n = 4 * self.depth
                stop = next((i for i in range(at + 1, stop) if keys[i][:n] != keys[at][:n]), stop)
            self._block(ids[at:stop], keys[at:stop], sig[at:stop])
            at = stop

    def _block(self, ids: list[int], keys: list[bytes], sig: np.ndarray) -> None:
        known = len(self.ids)
        agree = (sig[:, None, :] == self.sig[None, :known, :]).sum(2, dtype=np.int16) if known else np.zeros((len(ids), 0), np.int16)
        near = agree.max(1) >= NEAR if known else np.zeros(len(ids), bool)
        for row, col in zip(*np.nonzero(agree >= MAYBE)):
            self.sets.join(ids[row], self.ids[col])
        for row in np.flatnonzero(~near).tolist():  # a new leader, unless one of this block is near
            fresh = len(self.ids) - known
            if fresh:
                same = (self.sig[known : known + fresh] == sig[row]).sum(1)
                for k in np.flatnonzero(same >= MAYBE).tolist():
                    self.sets.join(ids[row], self.ids[known + k])
                if same.max() >= NEAR:
                    continue
            self.add_leader(ids[row], keys[row], sig[row])
        if len(self.ids) > known:  # members that were near an older leader meet the new ones as well
            late, several = np.flatnonzero(near), max(1, 40_000 // (len(self.ids) - known))
            for at in range(0, len(late), several):  # some at a time, as a block may hold many of both
                some = late[at : at + several]
                agree = (sig[some][:, None, :] == self.sig[None, known : len(self.ids), :]).sum(2, dtype=np.int16)
                for row, col in zip(*np.nonzero(agree >= MAYBE)):
                    self.sets.join(ids[some[row]], self.ids[known + col])


CANDIDATES = "tree int, stretch int, key binary, sig binary, a long, b long"


def grow(it: Iterator[pa.RecordBatch], merging: bool) -> Iterator[pa.RecordBatch]:
    """Rows (tree, stretch, key, id, sig) in order to candidate links (a, b) and leaders (tree, stretch, key, sig, a). A
    task's rows are a stretch of the trees' orders, of which the leaders of the regions at its ends are given; merging, they
    are leaders of several stretches, of which all that stay are given."""
    now, region, first, number = None, None, True, partition_id()

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        a, b = region.sets.links()
        if merging:
            leaders = region.added
        else:
            leaders = [(i, k, s.tobytes()) for i, k, s in zip(region.ids, region.prefixes, region.sig)] if first or last else []
        n, m = len(a), len(leaders)
        if n or m:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * n + [now[0]] * m, pa.int32()), pa.array([None] * n + [now[2] if merging else number] * m, pa.int32()), pa.array([None] * n + [k for _, k, _ in leaders], pa.binary()),
                 pa.array([None] * n + [s for _, _, s in leaders], pa.binary()), pa.array(a + [i for i, _, _ in leaders], pa.int64()), pa.array(b + [None] * m, pa.int64())],
                names=["tree", "stretch", "key", "sig", "a", "b"],
            )

    for batch in it:
        trees, stretches, keys, ids = (batch.column(c).to_pylist() for c in ("tree", "stretch", "key", "id"))
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        marks = [(t, k[:8], x) for t, k, x in zip(trees, keys, stretches)]
        at = 0
        while at < len(ids):
            stop = at + 1
            while stop < len(ids) and marks[stop] == marks[at]:
                stop += 1
            if marks[at] != now:
                if region is not None:
                    yield from out(False)
                    first = False
                now, region = marks[at], Region(merging)
            if region.ids or stop - at > 1:
                region.take(ids[at:stop], keys[at:stop], sig[at:stop])
            else:
                region.add_leader(ids[at], keys[at], sig[at])
            at = stop
    if region is not None:
        yield from out(True)


def confirm(it: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, p, q, side, part, id, text), those of a meeting (grp, p, q) together, to links (a, b). Classes of the
    same part are linked already; where a meeting is of two blocks, those of the same side aren't compared."""
    now, ids, sides, parts, sets = None, [], [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        found = linked(ids, sides if now[1] != now[2] else None, sets, percent, parts)
        a, b = found.links()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches(it, 2000, 2 << 20):
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "p", "q"))))
        new = shingle_sets(batch.column("text").to_pylist(), size)
        for mark, doc, side, part, s in zip(marks, *(batch.column(c).to_pylist() for c in ("id", "side", "part")), new):
            if mark != now:
                if now is not None:
                    yield from out()
                now, ids, sides, parts, sets = mark, [], [], [], []
            if len(s):
                ids.append(doc)
                sides.append(side)
                parts.append(part)
                sets.append(s)
    if now is not None:
        yield from out()
    _words.clear()


def linked(ids: list[int], sides: list[int] | None, sets: list[np.ndarray], percent: int, parts: list[int] | None = None) -> UnionFind:
    """Links all pairs whose sets are similar enough, but for those in one part, or linked by others; with sides, only
    those of different sides."""
    found = UnionFind()
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return found
    ids = [ids[i] for i in order]
    sizes = np.array([len(sets[i]) for i in order])
    side = np.array([sides[i] for i in order]) if sides else None
    labels, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(len(labels), np.uint8)
    first = np.searchsorted(sizes * 100, percent * sizes)  # shorter sets can't reach the threshold
    # what is linked so far, by place
    roots = np.unique([parts[i] for i in order], return_inverse=True)[1] if parts else np.arange(len(ids))
    for i in range(1, len(ids)):
        lo = int(first[i])
        if lo >= i:
            continue
        other = np.flatnonzero(roots[lo:i] != roots[i] if side is None else (roots[lo:i] != roots[i]) & (side[lo:i] != side[i])) + lo
        if not len(other):
            continue
        own = codes[starts[i] : starts[i + 1]]
        flag[own] = 1
        if 2 * len(other) > i - lo:
            same = np.add.reduceat(flag[codes[starts[lo] : starts[i]]], starts[lo:i] - starts[lo], dtype=np.int64)[other - lo]
        else:
            same = np.array([flag[codes[starts[j] : starts[j + 1]]].sum(dtype=np.int64) for j in other.tolist()])
        flag[own] = 0
        hit = 100 * same >= percent * (sizes[other] + sizes[i] - same)
        for j in other[hit].tolist():
            if roots[j] != roots[i]:
                found.join(ids[i], ids[j])
                roots[roots == roots[j]] = roots[i]
    return found


def candidate_links(classes: DataFrame) -> DataFrame:
    """classes: id, slots, sig. Links (a, b) whose connected groups hold all classes that may be linked."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("id", "slots", "sig", tree).select("tree", F.substring("slots", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("key"), "id", "sig")
    ranged = rows.withColumn("stretch", F.lit(0)).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = materialise(ranged.mapInArrow(lambda it: grow(it, False), CANDIDATES), "candidates")
    links = found.filter("b is not null").select("a", "b")
    while True:
        leaders = found.filter("b is null").select("tree", "stretch", "key", F.col("a").alias("id"), "sig", F.substring("key", 1, 8).alias("prefix"))
        several = leaders.groupBy("tree", "prefix").agg((F.min("stretch") < F.max("stretch")).alias("several")).filter("several").select("tree", "prefix")
        leaders = join_small(leaders, materialise(several, "several"), ["tree", "prefix"], "left_semi").withColumn("stretch", F.floor(F.col("stretch") / FAN).cast("int"))
        leaders = leaders.repartition("tree", "prefix", "stretch").sortWithinPartitions("tree", "prefix", "stretch", "key", "id")
        found = materialise(leaders.select("tree", "stretch", "key", "id", "sig").mapInArrow(lambda it: grow(it, True), CANDIDATES), "candidates")
        if not found.limit(1).count():
            return links
        links = links.union(found.filter("b is not null").select("a", "b"))


def _meet(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """rows: grp, p, q, side, part, id, text. A materialised table of the links that their meetings give."""
    dealt = rows.select("grp", "p", "q", "side", "part", "id", "text").repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q")
    return materialise(dealt.mapInArrow(lambda it: confirm(it, size, percent), "a long, b long"), "met")


def _blocks(n: str = "n") -> Column:
    return F.greatest(F.ceil(F.sum(n) / GROUP), F.ceil(F.count(F.lit(1)) / MEMBERS), F.lit(1)).cast("int")


def _parts(links: DataFrame) -> DataFrame:
    """(id, part) of all classes in links: the least one that they are linked with."""
    roots = components(links)
    return materialise(roots.select(F.col("node").alias("id"), F.col("root").alias("part")).union(roots.select(F.col("root").alias("id"), F.col("root").alias("part")).distinct()), "parts")


def confirmed_links(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """texts: a materialised table (grp, id, n, text) of the classes of candidate groups, n: the size of their sets. Links
    (a, b) that connect all classes of a group that are connected by pairs over the threshold."""
    block = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int")
    now, level, links = texts.select("grp", "id", "n"), 0, None
    while True:
        blocks = materialise(now.groupBy("grp").agg(_blocks().alias("blocks"), F.count(F.lit(1)).alias("members")), "blocks")
        some = texts if level == 0 else texts.join(now.select("id"), "id", "left_semi")
        dealt = some.join(blocks.drop("members"), "grp").withColumn("p", block(level))
        found = _meet(dealt.select("grp", "p", F.col("p").alias("q"), F.lit(0).alias("side"), F.col("id").alias("part"), "id", "text"), size, percent)
        links = found if links is None else links.union(found)
        large = blocks.filter("blocks > 1").select("grp", "members")
        if not large.limit(1).count():
            break
        # a block's links are stars, so what isn't a node of one stands for its part
        stay = now.join(large, "grp").join(found.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        left = materialise(stay.select("grp", "id", "n", "members"), "representatives")
        shrinks = left.groupBy("grp").agg(F.count(F.lit(1)).alias("now"), F.max("members").alias("before")).filter("now < before and now > 1").select("grp")
        level, now = level + 1, materialise(left.join(shrinks, "grp", "left_semi").drop("members"), "representatives")
        if not now.limit(1).count():
            break
    # groups of several blocks that are still in parts
    first = texts.groupBy("grp").agg(_blocks().alias("blocks")).filter("blocks > 1").select("grp")
    wide = materialise(texts.join(first, "grp", "left_semi").select("grp", "id", "n"), "wide")
    if not wide.limit(1).count():
        return links
    part = wide.join(_parts(links), "id", "left").select("grp", "id", "n", F.coalesce("part", "id").alias("part"))
    sizes = materialise(part.groupBy("grp", "part").agg(F.sum("n").alias("n")), "sizes")
    split = sizes.groupBy("grp").agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("grp", F.col("most.part").alias("most"))
    part = materialise(part.join(split, "grp").select("grp", "id", "n", "part", (F.col("part") == F.col("most")).alias("main")), "wide")
    if not part.limit(1).count():
        return links
    counts = part.groupBy("grp").agg(
        F.greatest(F.ceil(F.sum(F.when(F.col("main"), F.col("n"))) / GROUP), F.ceil(F.count(F.when(F.col("main"), 1)) / MEMBERS), F.lit(1)).cast("int").alias("mains"),
        F.greatest(F.ceil(F.sum(F.when(~F.col("main"), F.col("n"))) / GROUP), F.ceil(F.count(F.when(~F.col("main"), 1)) / MEMBERS), F.lit(1)).cast("int").alias("rests"),
    )
    # blocks of the rest are 0 to rests - 1, those of the main part come after
    number = F.when(F.col("main"), F.col("rests") + F.pmod(F.xxhash64("id", F.lit(-1)), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id", F.lit(-1)), F.col("rests"))).cast("int")
    other = F.when(F.col("main"), F.sequence(F.lit(0), F.col("rests") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1))
    dealt = part.join(counts, "grp").select("id", "part", number.alias("side"), F.explode(other).alias("other"))
    rows = texts.drop("n").join(dealt, "id").select("grp", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "part", "id", "text")
    return links.union(_meet(rows, size, percent))


def mark_of(text: Column) -> Column:
    """What tells rows with the same id, or none, apart."""
    return F.xxhash64(text.cast("binary"))


def near_components(docs: DataFrame, percent: int = 85, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return judged(docs, percent, size, doc_id, text)[0].drop("mark", "one")


def judged(docs: DataFrame, percent: int, size: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """near_components with the mark of each row's text and whether its id and mark are the ones that stand for the
    component (one); and the pairs of id and mark that several rows have, as _key."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), mark_of(F.col(text)).alias("mark"), F.col(text).cast("binary").alias("text"))
    keep: list[DataFrame] = []
    with freed_but(keep):
        found = materialise(rows.mapInArrow(lambda it: features(it, size), FEATURES), "features")
        repeats = materialise(found.groupBy("doc_id", "mark").count().filter("count > 1").select(F.struct("doc_id", "mark").alias("_key")), "repeats")
        classes = found.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("slots").alias("slots"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
        classes = materialise(classes.withColumn("id", F.xxhash64("set_key")), "classes")
        groups = components(candidate_links(classes))
        groups = materialise(groups.union(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
        members = classes.select("id", "n", "least").join(groups.withColumnRenamed("node", "id"), "id")
        members = members.select("id", "n", F.col("root").alias("grp"), F.col("least.doc_id").alias("_doc"), F.col("least.mark").alias("_mark"))
        texts = rows.filter("text is not null").join(members, (rows["doc_id"] == F.col("_doc")) & (rows["mark"] == F.col("_mark")))
        texts = texts.select(F.struct("doc_id", "mark").alias("_key"), F.struct("grp", "id", "n", "text").alias("_row"))
        texts = materialise(one_of_each(texts, "_key", repeats, F.lit(0)), "texts")
        links = confirmed_links(texts, size, percent)
        roots = _parts(links).withColumnRenamed("part", "root")
        linked = materialise(classes.select("id", "least").join(roots, "id"), "linked")  # written, as is best, so joins on hot roots can be split
        best = materialise(linked.groupBy("root").agg(F.min("least").alias("best")), "best")
        keep += [found, repeats, classes, linked, best]
    of_class = classes.select("set_key", "id", "least").join(linked.join(best, "root").select("id", "best"), "id", "left").select("set_key", F.coalesce("best", "least").alias("best"))
    out = found.select("doc_id", "mark", "n_shingles", "set_key").join(of_class, "set_key", "left")
    real = lambda c: F.when(c != NO_ID, c)
    component = F.coalesce("best.doc_id", "doc_id")
    one = (F.col("doc_id") == component) & (F.col("mark") == F.coalesce("best.mark", "mark"))
    return out.select(real(F.col("doc_id")).alias("doc_id"), "mark", "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"), one.alias("one")), repeats


def keep_one(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """The rows of docs that stay, the documents with the least id of each component, with all their columns."""
    goes = judged(docs, percent, size)[0].filter(~F.col("kept")).select(F.struct("doc_id", "mark").alias("_key")).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), own.alias("_key"))
    return rows.join(goes, "_key", "left_anti").select("_row.*")


def keep_single(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """keep_one, but one row of each component, also where several have its least id or none has one. Rows without words
    are a component by their id and text each."""
    found, repeats = judged(docs, percent, size)
    goes = found.filter(~F.col("one")).select(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "mark").alias("_key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), mark_of(F.col("text")).alias("mark")).alias("_key"))
    return one_of_each(rows.join(goes, "_key", "left_anti"), "_key", repeats, F.lit(0))
