"""Scores of texts under a log-bilinear neural language model.

Words are counted over all training documents. Words that occur `least` times get vectors of their own, so the vocabulary
grows with the corpus, up to `own` of them, the most frequent; so does the end token. They are dealt to classes: the `top`
most frequent and the end are classes of their own, the others lie, in the order of their letters from the last to the
first, in `classes` ranges of equally many. All words without a vector share one for the range that they fall in.

The probability of a word after the `CONTEXT` words before it is that of its class, times its own in the class; both are
normalised over products of vectors: each word before goes through the matrix of its place, and their sum is multiplied
with the vectors of all classes, or of all words of the class, and biases are added. A word without a vector has its share,
by the smoothed counts that the base score uses, in the probability of all those of its range. Over all words, with an
unseen one for each range, probabilities sum to one. Products are those of matrices for whole batches of texts.

Training is by noise-contrastive estimation, in numpy: every position of every training document, its end too, is a draw.
Nodes of the documents are written once. Each of `ROUNDS` rounds, a task for each `SHARE` draws goes through its own from
the model of the round before, and the models are averaged by their draws; of up to `SHARE` draws a single task trains, as
plain stochastic descent. A step takes windows of `WINDOW` positions from many documents, so what stands before several of
them goes through the matrices once.

Counts of the `kept` most frequent words of at most `LONGEST` bytes are broadcast (a fixed number); only the other words
of a text are shuffled to meet their counts, as rows of a word and its number in the text.

Defined results: a null text is empty and has its end token only. Without any training document every probability
that the counts would give is undefined and scores are null. Repeated rows and null ids are rows like others (a null
id counts as the empty text where rows are split). Long texts are read whole. An empty table gives no rows. Of further
columns none is read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import SPACE_CLASS, batches, crc_of_id, free, materialise, partition_id

#: The end token, which no word can be.
END = b""
ALPHA = 0.1
#: Words before a word that its probability depends on, and numbers of a vector.
CONTEXT, SIZE = 4, 16
SHARE, ROUNDS = 8_000_000, 2
#: Positions of a window, and draws of a long text that lie in one piece.
WINDOW, PIECE = 32, 8192
#: Draws that a step of training takes at most, and steps that a round has if there are draws for them; noise, for each, of classes and of words in a class.
BATCH, STEPS, NOISE, WORD_NOISE = 4096, 200, 16, 4
#: Step size of the first round.
RATE = 0.08
#: Bytes of a word that may be broadcast.
LONGEST = 64
#: Different words that a task counts before it hands them on, about.
COUNTED = 200_000
#: Numbers of a row in which models are averaged.
BLOCK = 4096


@dataclass
class Vocabulary:
    """words: number of each kept word. node, log_q: by that number, the last for other words. Nodes are the own words in
    the order of their classes, each range's followed by the node of its other words; starts: first node of each class.
    bounds: first keys of the ranges but for the first."""

    words: dict[bytes, int]
    node: np.ndarray
    log_q: np.ndarray
    starts: np.ndarray
    singles: int
    bounds: list[bytes]
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.kind = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)).astype(np.int32)  # class of each node
        self.edges = np.array(self.bounds, object)

    @property
    def nodes(self) -> int:
        return int(self.starts[-1])

    def other(self, word: bytes) -> int:
        """The node of a word without a vector of its own."""
        return int(self.starts[self.singles + bisect_right(self.bounds, key_of(word)) + 1]) - 1

    def others(self, words: list[bytes]) -> np.ndarray:
        """The nodes of words without vectors of their own."""
        keys = np.array([key_of(w) for w in words], object)
        return self.starts.take(self.singles + 1 + np.searchsorted(self.edges, keys, "right")) - 1

    def log10(self, count: int) -> float:
        return math.log10((count + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))


def key_of(word: bytes) -> bytes:
    """Letters from the last one to the first, without closing stops and commas."""
    return word.rstrip(b".,")[::-1]


def tokens_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Tokens of all texts, each text's closed by the end token, and how many each has. Bytes are taken as they are."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    # what is split at a blank at its end leaves an empty token there; an empty text is one by itself
    texts = pc.binary_join_element_wise(texts, pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), "")
    tokens = pc.ascii_split_whitespace(texts)
    return tokens.flatten(), tokens.value_lengths().to_numpy().astype(np.int64)


def different(tokens: pa.StringArray) -> tuple[pa.StringArray, list[bytes], np.ndarray]:
    """The different ones of tokens, in Arrow and as a list, and for each token its number among them."""
    found = tokens.dictionary_encode()
    return found.dictionary, bytes_of(found.dictionary), found.indices.to_numpy()


def bytes_of(words: pa.StringArray) -> list[bytes]:
    return words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def numbered(tokens: list[bytes], words: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(words.get, tokens, repeat(-1)), np.int32, len(tokens))


def nodes_of(tokens: list[bytes], number: np.ndarray, v: Vocabulary) -> np.ndarray:
    out = v.node.take(number)
    rest = np.flatnonzero(out < 0)
    out[rest] = v.others([tokens[i] for i in rest.tolist()])
    return out


def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows (word, c), a word's several times if a task meets very many different ones. Words are counted in Arrow."""
    found: list[pa.Table] = []
    n = 0

    def summed() -> pa.Table:
        table = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return table.select(["word", "c_sum"]).rename_columns(["word", "c"])

    for b in batches(it, 2000):
        word, c = tokens_of(b.column("text"))[0].value_counts().flatten()
        found.append(pa.table({"word": word, "c": c}))
        n += len(word)
        if n > 2 * COUNTED:
            found = [summed()]
            n = len(found[0])
            if n > COUNTED:
                yield from found[0].to_batches()
                found, n = [], 0
    if found:
        yield from summed().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over training documents, the end token among them."""
    rows = docs.filter(crc_of_id(F.col("doc_id")) % 10 != 0).select(F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """One vector of all numbers, and views of its parts: r, vectors of words before; c, matrices by place; classes, vectors
    and biases of classes (q and b); words, those of nodes in their class (qw and bw)."""

    def __init__(self, nodes: int, kinds: int, flat: np.ndarray | None = None) -> None:
        shapes = {"r": (nodes, SIZE), "c": (CONTEXT, SIZE, SIZE), "classes": (kinds, SIZE + 1), "words": (nodes, SIZE + 1)}
        self.flat = np.zeros(sum(math.prod(s) for s in shapes.values()), np.float32) if flat is None else flat
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        self.q, self.b = self.classes[:, :SIZE], self.classes[:, SIZE]
        self.qw, self.bw = self.words[:, :SIZE], self.words[:, SIZE]


def start(v: Vocabulary, mass: np.ndarray, seed: int = 5) -> Model:
    """Small random vectors of what stands before and none of what follows, so all starts from the shares, whose logs are
    the biases. mass: smoothed counts of the nodes."""
    rng = np.random.default_rng(seed)
    m = Model(v.nodes, len(v.starts) - 1)
    m.r[:] = rng.standard_normal(m.r.shape) * 0.1
    m.c[:] = rng.standard_normal(m.c.shape) * SIZE**-0.5
    of_class = np.add.reduceat(mass, v.starts[:-1])
    m.b[:] = np.log(of_class / of_class.sum())
    m.bw[:] = np.log(mass / of_class[v.kind])
    return m


def _sums(grad: np.ndarray, index: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers of index, those that occur more often first, and the sums of their rows of grad. With times, each
    row of grad stands for as many of index, one after the other, and times are its factors. Second rows are added to the
    first ones and so on, whole rows at once, until few numbers have as many."""
    each = len(index) // len(grad)

    def taken(at: np.ndarray) -> np.ndarray:
        if times is None:
            return grad.take(at, axis=0)
        out = grad.take(at // each, axis=0)
        out *= times.take(at)[:, None]
        return out

    order = np.argsort(index, kind="stable")
    index = index.take(order)
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    size = np.diff(first, append=len(order))
    upto = np.minimum(size, 10)
    often = np.argsort((10 - upto).astype(np.uint8), kind="stable")
    first, size = first.take(often), size.take(often)
    more = len(first) - np.cumsum(np.bincount(upto, minlength=11))  # how many have more rows than 0, 1 and so on, but for the last
    total, done = taken(order.take(first)), 1
    while done < 9 and more[done] > 128:
        total[: more[done]] += taken(order.take(first[: more[done]] + done))
        done += 1
    n = more[done]
    if n:
        left = size[:n] - done
        at = np.cumsum(left) - left
        rest = np.repeat(first[:n] + done - at, left) + np.arange(left.sum())
        total[:n] += np.add.reduceat(taken(order.take(rest)), at, axis=0)
    return index.take(first), total


def _put(param: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    whole = f"V{param.itemsize * param.shape[1]}"
    param.view(whole)[:, 0][rows] = values.view(whole)[:, 0]


def _rows(index: np.ndarray, grad: np.ndarray, param: np.ndarray, past: np.ndarray, rate: float | np.ndarray, times: np.ndarray | None = None) -> None:
    """A step of those rows that index names, each with the sum of its gradients."""
    rows, total = _sums(grad, index, times)
    seen = past.take(rows, axis=0)
    seen += total * total
    _put(past, rows, seen)
    total *= rate
    total /= np.sqrt(seen, out=seen)
    _put(param, rows, np.subtract(param.take(rows, axis=0), total, out=total))


def _whole(param: np.ndarray, past: np.ndarray, grad: np.ndarray, rate: float | np.ndarray) -> None:
    past += grad * grad
    param -= rate * grad / np.sqrt(past)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def aliases(mass: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables that draw nodes of a class by their mass: of a node that is taken evenly, the chance that it stays, and the
    node of the class that is drawn else."""
    stays, instead = np.ones(len(mass)), np.arange(len(mass), dtype=np.int32)
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        left = (mass[a:b] * ((b - a) / mass[a:b].sum())).tolist()
        low, high = [i for i, x in enumerate(left) if x < 1], [i for i, x in enumerate(left) if x >= 1]
        while low and high:
            i, j = low.pop(), high[-1]
            stays[a + i], instead[a + i] = left[i], a + j
            left[j] -= 1 - left[i]
            if left[j] < 1:
                low.append(high.pop())
    return stays, instead


class Trainer:
    """Noise-contrastive steps with step sizes by past gradients."""

    def __init__(self, m: Model, past: Model, v: Vocabulary, mass: np.ndarray, seed: int) -> None:
        self.m, self.past, self.v = m, past, v
        self.rng = np.random.default_rng(seed)
        self.kind = v.kind.astype(np.uint16)
        of_class = np.add.reduceat(mass, v.starts[:-1])
        self.class_edges = np.cumsum(of_class / of_class.sum())
        self.log_class = np.log(NOISE * of_class / of_class.sum()).astype(np.float32)
        stays, self.instead = aliases(mass, v.starts)
        self.stays = stays.astype(np.float32)
        self.starts, self.sizes = v.starts[:-1].astype(np.int32), np.diff(v.starts).astype(np.float32)
        self.log_word = np.log(WORD_NOISE * mass / of_class[v.kind]).astype(np.float32)
        self.rates = np.array([1] * SIZE + [0.2], np.float32)  # of vectors and biases

    def step(self, nodes: np.ndarray, live: np.ndarray, rate: float) -> None:
        """nodes: (k, CONTEXT + WINDOW), windows with the words before them; live: (k, WINDOW), which positions are draws."""
        m, past, v, rng = self.m, self.past, self.v, self.rng
        k, length = live.shape
        some = np.flatnonzero(live)
        target = nodes[:, CONTEXT:].ravel().take(some)
        kind = self.kind.take(target)
        order = np.argsort(kind, kind="stable")  # draws of a class lie together
        some, target, kind = some.take(order), target.take(order), kind.take(order)
        n = len(target)
        ra = m.r.take(nodes.ravel(), axis=0).reshape(k, -1, SIZE)
        before = runs(ra, length)
        rows = np.ones((n, SIZE + 1), np.float32)
        rows[:, :SIZE] = (before @ m.c[::-1].reshape(-1, SIZE)).take(some, axis=0)
        # classes, with noise that the batch shares
        shared = NOISE * 8
        times = np.bincount(np.minimum(np.searchsorted(self.class_edges, rng.random(shared)), len(m.b) - 1))
        false = np.flatnonzero(times)
        weight = (times.take(false) * (NOISE / shared)).astype(np.float32)
        true, columns = m.classes.take(kind, axis=0), -m.classes.take(false, axis=0)
        qf = -columns[:, :SIZE]
        g_true = _sigmoid(np.einsum("nl,nl->n", rows, true) - self.log_class.take(kind)) - 1
        gh = g_true[:, None] * true[:, :SIZE]
        columns[:, SIZE] += self.log_class.take(false)
        columns = np.ascontiguousarray(columns.T)
        g_false = np.zeros((SIZE + 1, len(false)), np.float32)
        buffer = np.empty((512, len(false)), np.float32)
        with np.errstate(over="ignore"):  # what overflows has a sigmoid of 0
            for at in range(0, n, 512):  # such a block stays in a core's cache
                part = rows[at : at + 512]
                s = np.matmul(part, columns, out=buffer[: len(part)])
                np.exp(s, out=s)
                s += 1
                np.divide(weight, s, out=s)
                gh[at : at + 512] += s @ qf
                g_false += part.T @ s
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        g_classes = np.zeros_like(m.classes)
        g_classes[kind.take(first)] = np.add.reduceat(g_true[:, None] * rows, first, axis=0)
        g_classes[false] += g_false.T
        # words in their class, with noise from the class
        inner = int(np.searchsorted(kind, v.singles))
        if inner < n:
            of, hs = kind[inner:], rows[inner:]
            size = self.sizes.take(of)[:, None]
            at = rng.random((n - inner, WORD_NOISE), np.float32)
            at *= size
            noise = np.minimum(at, size - 1).astype(np.int32)
            at -= noise
            noise += self.starts.take(of)[:, None]
            words = np.empty((n - inner, 1 + WORD_NOISE), np.uint16)
            words[:, 0] = target[inner:]
            words[:, 1:] = np.where(at < self.stays.take(noise), noise, self.instead.take(noise))
            qw = m.words.take(words, axis=0)
            g = _sigmoid(np.einsum("nwl,nl->nw", qw, hs) - self.log_word.take(words))
            g[:, 0] -= 1
            gh[inner:] += np.einsum("nw,nwl->nl", g, qw[:, :, :SIZE])
            _rows(words.ravel(), hs, m.words, past.words, rate * self.rates, g.ravel())
        spread = np.zeros((k, length + 2 * CONTEXT, SIZE), np.float32)  # gradients of h by position, for those up to CONTEXT later
        spread.reshape(-1, SIZE)[some + CONTEXT + some // length * (2 * CONTEXT)] = gh
        g_c = (before.T @ spread[:, CONTEXT : CONTEXT + length].reshape(-1, SIZE)).reshape(CONTEXT, SIZE, SIZE)[::-1]
        g_r = runs(spread[:, 1:], length + CONTEXT) @ m.c.transpose(0, 2, 1).reshape(-1, SIZE)
        _whole(m.classes, past.classes, g_classes, rate * self.rates)
        _rows(nodes.ravel(), g_r, m.r, past.r, rate)
        _whole(m.c, past.c, g_c, 0.2 * rate)


def runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Of (k, length, SIZE): at each of the first n places, CONTEXT rows from there on, one after the other."""
    by_window, by_row, by_number = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(rows), n, CONTEXT * SIZE), (by_window, by_row, by_number)).reshape(-1, CONTEXT * SIZE)


def drawn(it: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Every position of all texts, in rows of some thousands: pieces of unsigned 16-bit nodes, each with the CONTEXT ones
    before it, and how many draws each piece has."""
    v: Vocabulary = table.value
    end = np.full(CONTEXT, v.node[v.words[END]], "<u2")
    held: list[np.ndarray] = []
    sizes: list[int] = []
    n = 0

    def out() -> pa.RecordBatch:
        row = [pa.array([np.concatenate(held).tobytes()], pa.binary()), pa.array([np.array(sizes, "<u4").tobytes()], pa.binary()), pa.array([sum(sizes)], pa.int64())]
        held.clear()
        sizes.clear()
        return pa.RecordBatch.from_arrays(row, names=["draws", "sizes", "n"])

    for b in batches(it, 2000):
        tokens, lengths = tokens_of(b.column("text"))
        _, words, index = different(tokens)
        nodes, stop = nodes_of(words, numbered(words, v.words), v).astype("<u2").take(index), 0
        for length in lengths.tolist():
            start, stop = stop, stop + length
            text = np.concatenate([end, nodes[start:stop]])
            for at in range(0, length, PIECE):
                held.append(text[at : at + PIECE + CONTEXT])
                sizes.append(len(held[-1]) - CONTEXT)
                n += len(held[-1])
                if n >= 8192:
                    yield out()
                    n = 0
    if held:
        yield out()


def windows(held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (draws, sizes) to (k, CONTEXT + WINDOW) nodes and (k, WINDOW) marks of those that are draws."""
    stream = np.frombuffer(b"".join(d for d, _ in held), "<u2")
    size = np.frombuffer(b"".join(s for _, s in held), "<u4").astype(np.int64)
    k = -(-(len(stream) - CONTEXT) // WINDOW)
    fill = k * WINDOW + CONTEXT - len(stream)
    runs = np.stack([np.full(len(size), CONTEXT), size], 1).ravel()
    live = np.concatenate([np.repeat(np.arange(len(runs)) % 2 == 1, runs), np.zeros(fill, bool)])[CONTEXT:].reshape(k, WINDOW)
    stream = np.concatenate([stream, np.zeros(fill, stream.dtype)])
    return np.lib.stride_tricks.sliding_window_view(stream, CONTEXT + WINDOW)[::WINDOW], live


def trained(it: Iterator[pa.RecordBatch], table, round_no: int, batch: int) -> Iterator[pa.RecordBatch]:
    """A task's draws to rows (block, n, values) of the model that it comes to and, but for the last round, of its past
    gradients. n: its draws."""
    v, mass, flat, past = table.value
    m, past = Model(v.nodes, len(v.starts) - 1, flat.copy()), Model(v.nodes, len(v.starts) - 1, past.copy())
    trainer, n = Trainer(m, past, v, mass, 1000 * round_no + 7), 0
    held, count = [], 0
    for b in it:
        for draws, sizes, size in zip(b.column("draws").to_pylist(), b.column("sizes").to_pylist(), b.column("n").to_pylist()):
            held.append((draws, sizes))
            count += size
            if count >= 8 * BATCH:  # some rows at a time, so a step mixes many documents
                n += _pass(trainer, held, round_no, batch)
                held, count = [], 0
    if count:
        n += _pass(trainer, held, round_no, batch)
    if n:
        both = np.concatenate([m.flat, past.flat]) if round_no + 1 < ROUNDS else m.flat  # after the last round nothing steps
        for k in range(0, len(both), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([n], pa.int64()), pa.array([both[k : k + BLOCK].tobytes()], pa.binary())], names=["block", "n", "v"])


def _pass(trainer: Trainer, held: list[tuple[bytes, bytes]], round_no: int, batch: int) -> int:
    nodes, live = windows(held)
    order, several = trainer.rng.permutation(len(nodes)), max(1, batch // WINDOW)
    for at in range(0, len(nodes), several):
        some = order[at : at + several]
        trainer.step(nodes[some], live[some], RATE / (1 + round_no))
    return int(live.sum())


def averaged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, n, v), a block's together, to one row each with their mean by n."""
    now, total, weight = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["block", "v"])

    for b in it:
        for block, n, v in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), b.column("v").to_pylist()):
            values = np.frombuffer(v, "<f4").astype(np.float64) * n
            if block != now:
                if now is not None:
                    yield out()
                now, total, weight = block, values, n
            else:
                total, weight = total + values, weight + n
    if now is not None:
        yield out()


def train(draws: DataFrame, v: Vocabulary, mass: np.ndarray, share: int = SHARE) -> Model:
    """draws: a materialised table of `drawn`. A fixed number of numbers comes to the driver each round."""
    m = start(v, mass)
    past = np.full(len(m.flat), 0.01, np.float32)
    n = draws.agg(F.sum("n")).first()[0]
    if not n:
        return m
    rows, batch = draws.coalesce(-(-n // share)), max(64, min(BATCH, n // STEPS))
    for round_no in range(ROUNDS):
        table = draws.sparkSession.sparkContext.broadcast((v, mass, m.flat, past))
        parts = rows.mapInArrow(lambda it, t=table, k=round_no: trained(it, t, k, batch), "block int, n long, v binary")
        found = parts.repartition("block").sortWithinPartitions("block").mapInArrow(averaged, "block int, v binary").toArrow().sort_by("block")
        both = np.frombuffer(b"".join(found["v"].to_pylist()), "<f4")
        m, past = Model(v.nodes, len(v.starts) - 1, both[: len(m.flat)].copy()), both[len(m.flat) :].copy()
        table.destroy()
    return m


def most_frequent(counts: DataFrame, kept: int) -> list[tuple[bytes, int]]:
    """At most `kept` words of up to LONGEST bytes with their counts, the most frequent first: those from the lowest count on that leaves no
    more, found by a histogram of counts on a fine logarithmic scale, so tasks send only words that are kept."""
    counts = counts.filter(F.octet_length("word") <= LONGEST)
    step = F.floor(F.log2("c") * 64)
    sizes = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    lowest, n = None, 0
    for s in sorted(sizes, reverse=True):
        n += sizes[s]
        if n > kept:
            break
        lowest = s
    if lowest is None:
        return []
    found = counts.filter(step >= lowest).toArrow()
    return sorted(zip(found["word"].cast(pa.binary()).to_pylist(), found["c"].to_pylist()), key=lambda wc: (-wc[1], wc[0]))


def vocabulary(best: list[tuple[bytes, int]], own: int, top: int, classes: int, least: int, total: int, distinct: int) -> Vocabulary:
    """From kept words with their counts, the most frequent first, the end among them."""
    named = [w for w, c in best if w != END and c >= least][:own]
    singles = [*named[:top], END]
    rest = sorted(named[top:], key=lambda w: (key_of(w), w))
    cuts = [len(rest) * k // classes for k in range(classes + 1)]
    for k in range(1, classes):  # words with the same key stay in one range
        cuts[k] = max(cuts[k], cuts[k - 1])
        while 0 < cuts[k] < len(rest) and key_of(rest[cuts[k]]) == key_of(rest[cuts[k] - 1]):
            cuts[k] += 1
    cuts = sorted({c for c in cuts if c < len(rest)} | {0})
    ends = [*cuts[1:], len(rest)]
    bounds = [key_of(rest[c]) for c in cuts[1:]]
    node_of = {w: i for i, w in enumerate(singles)}
    starts, at = [*range(len(singles))], len(singles)
    for a, b in zip(cuts, ends):
        starts.append(at)
        node_of.update({w: at + i for i, w in enumerate(rest[a:b])})
        at += b - a + 1
    starts.append(at)
    if at > 1 << 16:
        raise ValueError("nodes are 16-bit numbers")
    denominator = total + ALPHA * (distinct + 1)
    node = np.array([node_of.get(w, -1) for w, _ in best] + [-1], np.int64)
    v = Vocabulary({w: i for i, (w, _) in enumerate(best)}, node, np.log10((np.array([c for _, c in best] + [0]) + ALPHA) / denominator), np.array(starts), len(singles), bounds, total, distinct)
    for i, (w, _) in enumerate(best):
        if node[i] < 0:
            node[i] = v.other(w)
    return v


def others(it: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Counts to rows (node, n, c): how many words without a vector of their own a range has, and their counts."""
    v, own = table.value
    n, c = np.zeros(v.nodes, np.int64), np.zeros(v.nodes, np.int64)
    for b in it:
        words = bytes_of(b.column("word"))
        some = [i for i, w in enumerate(words) if w not in own]
        nodes = v.others([words[i] for i in some])
        n += np.bincount(nodes, minlength=v.nodes)
        c += np.bincount(nodes, weights=b.column("c").to_numpy()[some], minlength=v.nodes).astype(np.int64)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(c[used])], names=["node", "n", "c"])


class Products:
    """Vectors q and biases b, ready for products with rows that end with a one."""

    def __init__(self, q: np.ndarray, b: np.ndarray) -> None:
        self.rows = np.concatenate([q, b[:, None]], 1)
        self.columns = np.ascontiguousarray(self.rows.T)
        self.ones = np.ones(len(q), np.float32)
        self.norm, self.bias = math.sqrt(float((q * q).sum(1).max())), float(np.abs(b).max())

    def log_softmax(self, h: np.ndarray, index: np.ndarray, norm: float, buffer: np.ndarray) -> np.ndarray:
        """Of each row of h times all vectors, the log of the softmax at an index. norm: the largest of h's rows. A block of
        rows stays in a core's cache; numbers that might overflow are shifted first."""
        sure = norm * self.norm + self.bias < 80
        rows, n = max(1, len(buffer) // len(self.ones)), len(self.ones)
        hit = np.einsum("nl,nl->n", h, self.rows.take(index, axis=0))
        for at in range(0, len(h), rows):
            part = h[at : at + rows]
            s = np.matmul(part, self.columns, out=buffer[: len(part) * n].reshape(len(part), n))
            if not sure:
                top = s.max(1)
                s -= top[:, None]
                hit[at : at + rows] -= top
            np.exp(s, out=s)
            hit[at : at + rows] -= np.log(s @ self.ones)
        return hit


class Scorer:
    """The parts of a trained model that scoring needs. share: log10 of each node's share of all tokens. places: (CONTEXT,
    nodes, SIZE), vectors through the matrix of their place."""

    def __init__(self, v: Vocabulary, m: Model, share: np.ndarray) -> None:
        self.v, self.m, self.share = v, m, share
        self.places = np.stack([m.r @ c for c in m.c])
        self.kinds = Products(m.q, m.b)
        self.words = [Products(m.qw[a:b], m.bw[a:b]) for a, b in zip(v.starts[v.singles :], v.starts[v.singles + 1 :])]
        self.buffer = np.empty(max(1 << 18, len(m.b)), np.float32)

    def log_probabilities(self, nodes: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Normalised log10 probabilities of nodes after the CONTEXT ones before, the last one first."""
        v = self.v
        order = np.argsort(v.kind.take(nodes).astype(np.uint16), kind="stable")
        nodes = nodes.take(order)
        kind = v.kind.take(nodes)
        h = np.ones((len(nodes), SIZE + 1), np.float32)
        h[:, :SIZE] = sum(self.places[j].take(b.take(order), axis=0) for j, b in enumerate(before))
        norm = math.sqrt(float(np.einsum("nl,nl->n", h, h).max()))
        found = self.kinds.log_softmax(h, kind, norm, self.buffer)
        stops = np.searchsorted(kind, np.arange(v.singles, len(v.starts)))
        for k, products, lo, hi in zip(range(v.singles, len(v.starts) - 1), self.words, stops, stops[1:]):
            if hi > lo:
                found[lo:hi] += products.log_softmax(h[lo:hi], nodes[lo:hi] - v.starts[k], norm, self.buffer)
        out = np.empty(len(nodes), np.float64)
        out[order] = found
        return out / math.log(10)


def fit(docs: DataFrame, kept: int, own: int, top: int, classes: int, least: int, share: int = SHARE) -> tuple[Scorer, DataFrame] | None:
    """The model and the table of all counts; None without a training document."""
    spark = docs.sparkSession
    counts = materialise(count_words(docs), "counts")
    stats = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if not stats["v"]:
        return None
    best = most_frequent(counts, kept)
    if END not in {w for w, _ in best}:
        best.append((END, counts.filter("word = ''").first()["c"]))
    v = vocabulary(best, own, top, classes, least, int(stats["n"]), int(stats["v"]))
    own_words = {w: c for (w, c), k in zip(best, v.node) if v.other(w) != k or w == END}
    denominator = v.total + ALPHA * (v.distinct + 1)
    mass = np.zeros(v.nodes)
    for w, c in own_words.items():
        mass[v.node[v.words[w]]] = c + ALPHA
    last = v.starts[v.singles + 1 :] - 1
    mass[last] = ALPHA  # an unseen word in each range
    table = spark.sparkContext.broadcast((v, set(own_words)))
    for r in counts.mapInArrow(lambda it: others(it, table), "node long, n long, c long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():
        mass[r["node"]] += r["c"] + ALPHA * r["n"]
    table.destroy()
    table = spark.sparkContext.broadcast(v)
    rows = docs.filter(crc_of_id(F.col("doc_id")) % 10 != 0).select(F.col("text").cast("binary").alias("text"))
    draws = materialise(rows.mapInArrow(lambda it: drawn(it, table), "draws binary, sizes binary, n long"), "draws")
    m = train(draws, v, mass, share)
    free(draws)
    table.destroy()
    return Scorer(v, m, np.log10(mass / denominator)), counts


SCORED = "key string, rid long, tf long, doc_id long, n_tokens long, n_known long, base double, gain double"


def score_rows(it: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """A row per document, under a key that is no word, and a row per other word in it than the kept ones."""
    scorer: Scorer = table.value
    v = scorer.v
    end = int(v.node[v.words[END]])
    known = v.log_q > v.log10(0) + 1e-12
    next_id = partition_id() << 40
    for b in batches(it, 2000, 1 << 20):
        docs = b.column("doc_id")
        tokens, sizes = tokens_of(b.column("text"))
        dictionary, words, index = different(tokens)
        number = numbered(words, v.words)
        nodes, number = nodes_of(words, number, v).take(index), number.take(index)
        first = np.concatenate([[0], np.cumsum(sizes)])
        padded = np.full(len(nodes) + CONTEXT * len(docs), end, np.int64)  # what stands before a text are end tokens
        of = np.repeat(np.arange(len(docs)), sizes)
        place = np.arange(len(nodes)) + CONTEXT * (of + 1)
        padded[place] = nodes
        before = [padded.take(place - j) for j in range(1, CONTEXT + 1)]
        gain = scorer.log_probabilities(nodes, before) - scorer.share.take(nodes)
        kept = number >= 0
        sums = lambda x: np.add.reduceat(x, first[:-1])
        n_known, base, gains = sums(kept & known.take(number)), sums(np.where(kept, v.log_q.take(number), 0.0)), sums(gain)
        other = np.flatnonzero(~kept)
        rare, tf = np.unique(of.take(other) * len(words) + index.take(other), return_counts=True)
        n, m = len(docs), len(rare)
        ids = np.arange(next_id, next_id + n)
        next_id += n
        key = pa.concat_arrays([pa.array([f" {i}" for i in ids.tolist()], pa.string()), dictionary.take(pa.array(rare % len(words)))])
        values = [docs.cast(pa.int64()), *(pa.array(x, kind) for x, kind in ((sizes, pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (gains, pa.float64())))]
        yield pa.RecordBatch.from_arrays(
            [key, pa.array(np.concatenate([ids, ids.take(rare // len(words))])), pa.array(np.concatenate([np.zeros(n, np.int64), tf]))]
            + [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in values],
            names=[f.split()[0] for f in SCORED.split(", ")],
        )


def score(docs: DataFrame, kept: int = 131_072, own: int = 49_152, top: int = 63, classes: int = 192, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held_out = (crc_of_id(F.col("doc_id")) % 10 == 0).alias("held_out")
    fitted = fit(docs, kept, own, top, classes, least)
    if fitted is None:
        n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+"), "")) + 1
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), none.alias("base_score"), none.alias("score"))
    scorer, counts = fitted
    m = scorer.v
    table = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lambda it: score_rows(it, table), SCORED)
    rows = rows.join(counts.withColumnRenamed("word", "key"), "key", "left")
    share = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / (m.total + ALPHA * (m.distinct + 1)))
    n_known = F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))  # of a document's row, or of another word's
    sums = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(n_known).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * share)).alias("base_score"), F.max("gain").alias("gain"),
    )
    return sums.select("doc_id", held_out, "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
