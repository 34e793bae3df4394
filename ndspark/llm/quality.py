"""Document quality by attention-based multiple-instance learning.

Each text is a bag of passages. Every passage is encoded (kinds of characters, pairs of kinds,
lengths and repetition of words) and mapped to a hidden vector; gated attention, learned from
document labels alone, weighs the passages, and the weighted mean gives the document's score.

A null or empty text is one empty passage. Texts are read whole; what one needs grows with the
longest text of a slice only. Repeated rows score alike. Without labels of both kinds every score is 1,
so that a filter keeps all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, labelled_sample, slices

#: Bytes of a passage; labelled documents of each class that a fit reads at most (about); passages of
#: one of these, beyond which neighbours are averaged (in a fit only); passages of all of these, about 70 MB of features.
PASSAGE, PER_CLASS, FIT_PASSAGES, FIT_ROWS = 400, 2500, 64, 80_000
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 24, 12, 14, 128, 4e-3, 1e-4

#: Kinds of characters, by byte; the last kind has all others.
KIND_BYTES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"'\"`", b"|", b"#$%&*@^~", b"()[]{}<>", b"+-=_/\\", bytes(range(128, 256)))
N_KINDS = len(KIND_BYTES) + 1
KIND = np.full(256, N_KINDS - 1, np.int64)
for _k, _bytes in enumerate(KIND_BYTES):
    KIND[list(_bytes)] = _k
N_FEATURES = N_KINDS + N_KINDS**2 + 7


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per passage, and the first row of each text."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    firsts = np.concatenate([[0], counts.cumsum()[:-1]]).astype(np.int64)
    n = int(counts.sum())
    x = np.zeros((n, N_FEATURES), np.float32)
    kinds = KIND[np.frombuffer(b"".join(raw), np.uint8)]
    inside = np.arange(len(kinds)) - np.repeat(sizes.cumsum() - sizes, sizes)
    passage = np.repeat(firsts, sizes) + inside // PASSAGE
    length = np.bincount(passage, minlength=n).astype(np.float32)
    x[:, :N_KINDS] = np.bincount(passage * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS)
    pairs = passage[:-1] * N_KINDS**2 + kinds[:-1] * N_KINDS + kinds[1:]
    x[:, N_KINDS : N_KINDS + N_KINDS**2] = np.bincount(pairs[passage[1:] == passage[:-1]], minlength=n * N_KINDS**2).reshape(n, -1)
    x[:, : N_KINDS + N_KINDS**2] /= np.maximum(length, 1)[:, None]
    own = x[:, N_KINDS + N_KINDS**2 :]
    row = 0
    for r, count in zip(raw, counts.tolist(), strict=True):
        before: set[bytes] = set()
        for k in range(count):
            words = r[k * PASSAGE : (k + 1) * PASSAGE].split()
            if words:
                w, here = len(words), set(words)
                own[row] = (len(here) / w, sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(len, words)) / w / 10, len(here & before) / len(here), max(map(len, words)) / 50, w / 100, 1)
                before |= here
            row += 1
    return x, firsts


def pooled(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows, by averaging runs of neighbours."""
    if len(x) <= most:
        return x
    cuts = (np.arange(most) * len(x)) // most
    return np.add.reduceat(x, cuts) / np.diff([*cuts, len(x)])[:, None]


@dataclass(frozen=True)
class Model:
    """Standardises passages, then hidden layer, gates and output."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, bags = self.p, np.diff([*firsts, len(x)])
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), bags))
        a = e / np.repeat(np.add.reduceat(e, firsts), bags)
        z = np.add.reduceat(a[:, None] * h, firsts)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30))), (h, v, u, a, z, bags)

    def attention(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, firsts)[1][3]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, firsts = encode(texts)
        return self.forward((x - self.mean) / self.scale, firsts)[0].astype(float)

    def gradients(self, x: np.ndarray, firsts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, v, u, a, z, bags) = self.forward(x, firsts)
        g = (score - y) * weight / weight.sum()
        dz = np.repeat(g[:, None] * p["c"], bags, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, firsts), bags))
        dgate = de[:, None] * p["a"]
        dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ de, "c": z.T @ g, "d": g.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags)
    mean, scale = x.mean(0), x.std(0) + 0.01
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(mean, scale, {"w": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATES), "u": draw(HIDDEN, GATES), "a": draw(GATES), "c": draw(HIDDEN), "d": np.float32(0)})
    m, s, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick, step = order[at : at + BATCH], step + 1
            sizes = np.array([len(bags[k]) for k in pick])
            grads = model.gradients(np.concatenate([bags[k] for k in pick]), sizes.cumsum() - sizes, y[pick], weight[pick])
            for k, g in grads.items():  # Adam with decay of the weights
                g = g + DECAY * model.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                rate = RATE * (1 - epoch / EPOCHS)
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def passages_each(sample: DataFrame, rows: int) -> int:
    """How many passages a text of sample may bring, so that all bring at most about `rows`: a power of two, FIT_PASSAGES at most."""
    steps = [2**k for k in range(FIT_PASSAGES.bit_length()) if 2**k <= FIT_PASSAGES]
    own = F.ceil(F.octet_length("text") / PASSAGE)
    totals = sample.agg(*[F.coalesce(F.sum(F.greatest(F.lit(1), F.least(own, F.lit(k)))), F.lit(0)) for k in steps]).first()
    return max([1, *(k for k, n in zip(steps, totals, strict=True) if n <= rows)])


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, rows: int = FIT_ROWS) -> Model | None:
    """A model from about per_class labelled documents of each class at most; Spark encodes them, the driver
    gets their passages' features, those of about `rows` passages at most (one for each document at least)."""
    sample, stands_for = labelled_sample(docs, labels, label, held_out, per_class, id_col, text_col)
    if not stands_for:
        return None
    sample = cut(sample)
    most = passages_each(sample, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, firsts = encode(b.column("text").to_pylist())
            bags = [pooled(x[i:j], most).astype(np.float32).tobytes() for i, j in zip(firsts, [*firsts[1:], len(x)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(bags, pa.binary())], ["y", "bag"])

    bags = sorted((r.y, bytes(r.bag)) for r in sample.mapInArrow(run, "y int, bag binary").dropDuplicates().collect())
    if len({y for y, _ in bags}) < 2:
        return None
    y = np.array([y for y, _ in bags], np.float32)
    return train([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, b in bags], y, np.array([stands_for[int(k)] for k in y], np.float32))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores, all others as they were."""
    kept = docs.schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            scores = model.scores(texts) if model else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(scores, pa.float64())], [*kept, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
