"""Language ID with a bidirectional gated recurrent network over bytes.

Texts are read in segments of `SEGMENT` bytes. A forward and a backward recurrent layer see every byte; each position
gets its own distribution over the languages, and a document's probabilities are the mean over all its positions. The
network is trained on the driver, in numpy, by backpropagation through time on short windows of a bounded sample: of
the `most` most frequent languages, the `per_lang` documents with the smallest hashes of id and text, `windows` evenly
placed windows of each. Every byte of every text is labelled when predicting.

The model is a few thousand numbers and goes to the tasks with the function. A task holds a block of segments at a
time, so long texts cost memory for a block only.

Defined results: `und` with score 0 for a null text or one without letters. Rows that repeat and null ids are rows
like others; a null id counts as the empty text where rows are split. Rows with a null language are never learned
from; without any labelled row, or any window of one, all texts are `und`. An empty table gives no rows; of further columns
none is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.common import batches, crc_of_id

HIDDEN = 10
SEGMENT = 128
BLOCK = 2048  # segments at a time
PAD = 256
WINDOW = 40  # bytes of a training window


@dataclass
class BiGRU:
    """x: (2, 257, 3h) input tables; u: (2, h, 3h) recurrent weights; v: (2, h, n) and b: (n,) of the output."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    b: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.b]


def sigmoid(a: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5
    return a


def softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(-1, keepdims=True))
    return a / a.sum(-1, keepdims=True)


def states(m: BiGRU, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """codes: (time, batch). The states (2, time, batch, h), both in the order of time."""
    steps, n = codes.shape
    h = m.u.shape[1]
    both = np.stack([codes, codes[::-1]])
    out = np.empty((2, steps, n, h), np.float32)
    now = np.zeros((2, n, h), np.float32)
    inputs = np.empty((2, n, 3 * h), np.float32)
    for t in range(steps):
        np.take(m.x[0], both[0, t], axis=0, out=inputs[0])
        np.take(m.x[1], both[1, t], axis=0, out=inputs[1])
        back = now @ m.u
        gates = sigmoid(inputs[..., : 2 * h] + back[..., : 2 * h])
        z, r = gates[..., :h], gates[..., h:]
        c = np.tanh(inputs[..., 2 * h :] + r * back[..., 2 * h :])
        new = c + z * (now - c)
        if keep is not None:
            keep.append((now, z, r, c, back[..., 2 * h :]))
        out[:, t] = now = new
    out[1] = out[1, ::-1].copy()
    return out


def positions(m: BiGRU, s: np.ndarray) -> np.ndarray:
    """Distributions (time, batch, n) of every position."""
    return softmax(s[0] @ m.v[0] + s[1] @ m.v[1] + m.b)


def gradients(m: BiGRU, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions that aren't padding, and its gradients, through time."""
    keep: list = []
    s = states(m, codes, keep)
    p = positions(m, s)
    mask = (codes != PAD).astype(np.float32)
    total = max(1.0, float(mask.sum()))
    loss = -float((np.log(p[:, np.arange(len(target)), target] + 1e-9) * mask).sum()) / total
    d = p
    d[:, np.arange(len(target)), target] -= 1
    d *= mask[..., None] / total
    flat = d.reshape(-1, d.shape[-1])
    h = m.u.shape[1]
    gv = np.stack([s[k].reshape(-1, h).T @ flat for k in (0, 1)])
    gb = flat.sum(0)
    ds = np.stack([d @ m.v[0].T, (d @ m.v[1].T)[::-1]])  # in each direction's own order
    both = np.stack([codes, codes[::-1]])
    gx, gu = np.zeros_like(m.x), np.zeros_like(m.u)
    carry = np.zeros_like(keep[0][0])
    for t in range(len(codes) - 1, -1, -1):
        before, z, r, c, back = keep[t]
        dh = ds[:, t] + carry
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * back * r * (1 - r)
        into = np.concatenate([dz, dr, dc], -1)
        rec = np.concatenate([dz, dr, dc * r], -1)
        gu += before.transpose(0, 2, 1) @ rec
        carry = dh * z + rec @ m.u.transpose(0, 2, 1)
        for k in (0, 1):
            np.add.at(gx[k], both[k, t], into[k])
    return loss, [gx, gu, gv, gb]


def train(texts: list[bytes], labels: list[int], langs: list[str], steps: int = 260, batch: int = 192, rate: float = 0.012, seed: int = 7) -> BiGRU:
    """texts: windows of training documents; labels: their languages' numbers."""
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, len(langs)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = BiGRU(langs, draw(2, 257, 3 * h, scale=0.4), draw(2, h, 3 * h, scale=h**-0.5), draw(2, h, n, scale=0.3), np.zeros(n, np.float32))
    if n < 2 or not texts:
        return m
    codes = np.full((len(texts), WINDOW), PAD, np.int32)
    for i, t in enumerate(texts):
        codes[i, : min(WINDOW, len(t))] = np.frombuffer(t[:WINDOW], np.uint8)
    y = np.array(labels)
    groups = [np.flatnonzero(y == k) for k in range(n)]
    groups = [g for g in groups if len(g)]
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])  # as many of each language
        _, grads = gradients(m, np.ascontiguousarray(codes[pick].T), y[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(m.params(), grads, first, second):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def pooled(m: BiGRU, texts: list[bytes]) -> np.ndarray:
    """Mean over positions of each text's distributions; rows of zeros for empty texts."""
    n = len(m.langs)
    total = np.zeros((len(texts), n), np.float64)
    codes = np.full((BLOCK, SEGMENT), PAD, np.int32)
    owner: list[int] = []

    def flush() -> None:
        k = len(owner)
        block = np.ascontiguousarray(codes[:k].T)
        p = positions(m, states(m, block)) * (block != PAD)[..., None]
        np.add.at(total, owner, p.sum(0, dtype=np.float64))
        owner.clear()
        codes.fill(PAD)

    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        for at in range(0, len(data), SEGMENT):
            part = data[at : at + SEGMENT]
            codes[len(owner), : len(part)] = part
            owner.append(i)
            if len(owner) == BLOCK:
                flush()
    if owner:
        flush()
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def share_of(n: int, per_lang: int) -> int:
    """Of 2 ** 62 hashes, those that leave about twice per_lang of n rows."""
    return min(1 << 62, (2 * per_lang << 62) // max(1, n))


def sample_windows(docs: DataFrame, per_lang: int, windows: int, most: int) -> tuple[list[bytes], list[int], list[str]]:
    """Windows of up to per_lang training documents of each language: those with the smallest hashes. A share of hashes
    is cut off first, so that only about twice the sample of a language is ranked."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_of_id(F.col("doc_id")) % 4 != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    langs = sorted(counts)
    if not langs:
        return [], [], []
    limits = docs.sparkSession.createDataFrame([(k, share_of(counts[k], per_lang)) for k in langs], "lang string, share long")
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    data = F.col("text").cast("binary")
    places = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(data, (i * F.greatest(F.length(data) - WINDOW, F.lit(0)) / max(1, windows - 1)).cast("int") + 1, F.lit(WINDOW)))
    some = rows.withColumn("h", h).join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("share")).select("lang", "h", places.alias("w"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "w"))
    picked = some.withColumn("k", place).filter(F.col("k") <= per_lang).orderBy("lang", "k").collect()
    number = {k: i for i, k in enumerate(langs)}
    texts = [(bytes(w), number[r["lang"]]) for r in picked for w in r["w"] if w]
    return [t for t, _ in texts], [k for _, k in texts], langs if texts else []


def identify(docs: DataFrame, per_lang: int = 500, windows: int = 6, most: int = 256, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    m = train(*sample_windows(rows, per_lang, windows, most))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4000, 4 << 20):
            texts = [t if ok else b"" for t, ok in zip(b.column("text").to_pylist(), b.column("ok").to_pylist())]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if m.langs:
                p = pooled(m, texts)
                for i, (k, s) in enumerate(zip(p.argmax(1).tolist(), p.max(1).tolist())):
                    if texts[i]:
                        names[i], scores[i] = m.langs[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    ok = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ready = rows.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("text").cast("binary").alias("text"), ok.alias("ok"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
