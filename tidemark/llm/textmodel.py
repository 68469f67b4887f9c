"""Small linear text models: hashed byte trigrams and layout figures of whole texts, fitted in numpy on bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NO_WORD, Words, chunks

BUCKETS = 1 << 16
LAYOUT = 11
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True
_UPPER, _DIGIT, _MARK = np.zeros((3, 256))
_UPPER[0x41:0x5B] = 1
_DIGIT[0x30:0x3A] = 1
_MARK[NO_WORD] = 1
_MARK[[0x09, 0x0A, 0x0D, 0x20]] = 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``offsets``."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram that lies within one text, and the offsets of each text's trigrams."""
    raw = words.raw.astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(words) + 1, dtype=np.int64)
    key = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    lengths = np.maximum(np.diff(words.offsets) - 2, 0)
    inside = np.ones(len(bucket), dtype=bool)
    for k in (1, 2):
        last = words.offsets[1:] - k
        inside[last[(last >= 0) & (last < len(bucket))]] = False
    for k in (1, 2):  # texts of one byte or none reach into their neighbours
        short = words.offsets[1:-1] - k
        inside[short[(short >= 0) & (short < len(bucket))]] = False
    return bucket[inside], np.concatenate(([0], np.cumsum(lengths)))


def layout(words: Words, lines: Words) -> np.ndarray:
    """Figures of each text that do not depend on its words: length, lines, kinds of characters, repetition."""
    n_bytes = np.diff(words.offsets)
    n_words = np.diff(words.bounds)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    h = words.hashes()
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    same[words.bounds[:-1][n_words > 0]] = 0
    n_lines = np.diff(lines.bounds)
    owner = np.repeat(np.arange(len(lines)), n_lines)
    pairs = np.lexsort((line_hash := lines.hashes(), owner))
    fresh = np.ones(len(pairs))
    fresh[1:] = (line_hash[pairs][1:] != line_hash[pairs][:-1]) | (owner[pairs][1:] != owner[pairs][:-1])
    distinct = np.bincount(owner[pairs], fresh, minlength=len(lines))
    return np.column_stack(
        [
            np.log1p(n_bytes),
            np.log1p(n_words),
            np.log1p(n_lines),
            np.log1p(n_bytes / np.maximum(n_lines, 1)),
            _sums(_UPPER[words.raw], words.offsets) * per_byte,
            _sums(_DIGIT[words.raw], words.offsets) * per_byte,
            np.sqrt(_sums(_MARK[words.raw], words.offsets) * per_byte),
            _sums(words.raw >= 0x80, words.offsets) * per_byte,
            np.log1p(n_bytes * per_word),
            _sums(same, words.bounds) * per_word,
            1 - distinct / np.maximum(n_lines, 1),
        ]
    )


def views(texts: pa.Array):
    """Pieces ``(trigram buckets, offsets, layout)`` of a batch of texts."""
    for (_, words), (_, lines) in zip(chunks(texts), chunks(texts, _NEWLINE), strict=True):
        yield *trigrams(words), layout(words, lines)


def some_ids(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of the different ids in ``ids(doc_id, ...)``, those least by a hash; small enough to be sent to every task.

    A bound on the hash leaves about twice as many as asked for, so that not every task has to hand in as many as ``limit``.
    """
    ids = ids.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("_hash", F.xxhash64("doc_id"))
    number = ids.count()
    if number > 4 * limit:
        ids = ids.where(F.col("_hash") < int(-(2**63) + 2**64 * (2 * limit / number)))
    return F.broadcast(ids.orderBy("_hash", "doc_id").limit(limit).drop("_hash"))


class Sparse:
    """Hashed trigrams of some texts: for each text its buckets and a value for each, in few bytes."""

    def __init__(self, offsets: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        self.offsets, self.bucket, self.value = offsets.astype(np.int64), bucket.astype(np.uint16), value.astype(np.float32)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, bucket, value)`` of the chosen rows; owners count from 0."""
        n = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.bucket[at].astype(np.int64), self.value[at]

    def take(self, rows: np.ndarray) -> Sparse:
        owner, bucket, value = self.entries(rows)
        return Sparse(np.searchsorted(owner, np.arange(len(rows) + 1)), bucket, value)

    def joined(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate((self.offsets, self.offsets[-1] + other.offsets[1:])), np.concatenate((self.bucket, other.bucket)), np.concatenate((self.value, other.value)))

    def margins(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Logit of class 1 over class 0 of every row."""
        out = [np.zeros(0)]
        for k in range(0, len(self), BATCH):
            owner, bucket, value = self.entries(np.arange(k, min(k + BATCH, len(self))))
            out.append(np.bincount(owner, value * (w[bucket, 1] - w[bucket, 0]), minlength=min(BATCH, len(self) - k)))
        return np.concatenate(out) + b[1] - b[0]


def sampled(docs: DataFrame, limit: int, keep: tuple[str, ...]) -> dict:
    """Features of at most ``limit`` rows, those least by a hash of all of ``keep``: ``trigrams`` (``Sparse``), ``layout`` and ``keep``.

    A value is the bucket's share of the text's trigrams times ``SCALE``. All of a text counts; its entries are 65,536 at most.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for bucket, offsets, figures in views(batch.column(batch.num_columns - 1)):
                for a, b, own in zip(offsets[:-1], offsets[1:], figures, strict=True):
                    at, n = np.unique(bucket[a:b], return_counts=True)
                    rows.append((at.astype(np.int32), (n * (SCALE / max(1, b - a))).astype(np.float32), own))
            cols = [pa.array([r[k] for r in rows], type=pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keep, "buckets", "shares", "layout"])

    picked = docs.withColumn("text", F.col("text").cast("binary")).orderBy(F.xxhash64(*keep), *keep).limit(limit).select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1]), "buckets array<int>, shares array<float>, layout array<double>"])
    table = picked.mapInArrow(run, schema).toArrow()
    out = {c: table.column(c).to_pylist() for c in keep}
    n, bucket, value, figures = ([np.zeros(0, t)] for t in (np.int64, np.uint16, np.float32, np.float64))
    for batch in table.to_batches():
        lists = batch.column(len(keep))  # copied below, so that the table can go
        n.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        bucket.append(lists.flatten().to_numpy().astype(np.uint16))
        value.append(batch.column(len(keep) + 1).flatten().to_numpy().copy())
        figures.append(batch.column(len(keep) + 2).flatten().to_numpy().copy())
    del table
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(n))))
    out |= {"trigrams": Sparse(offsets, np.concatenate(bucket), np.concatenate(value)), "layout": np.concatenate(figures).reshape(-1, LAYOUT)}
    pa.default_memory_pool().release_unused()
    return out


SCALE = 30.0  # makes shares of a text's trigrams about as large as standardised figures
BATCH = 256


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    """Steps of Adam on arrays that are changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, d, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _prior(y: np.ndarray, classes: int, weight: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(np.bincount(y, weight, minlength=classes), 1e-9) / max(weight.sum(), 1e-9))


def fit_dense(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, steps: int = 100, decay: float = 1e-3):
    """Multinomial logistic regression on a small matrix by Adam over all rows. Returns weights and biases."""
    w, b, target = np.zeros((x.shape[1], classes)), _prior(y, classes, weight), np.eye(classes)[y]
    adam = _Adam([w, b], 0.1)
    for _ in range(steps):
        g = (_softmax(x @ w + b) - target) * (weight / max(weight.sum(), 1e-9))[:, None]
        adam.step([x.T @ g + decay * w / classes, g.sum(axis=0)])
    return w, b


def fit_sparse(x: Sparse, y: np.ndarray, classes: int, weight: np.ndarray, epochs: int = 16, decay: float = 1e-3):
    """Multinomial logistic regression on hashed trigrams by Adam over batches of ``BATCH`` rows, so that memory doesn't grow with their number."""
    w, b = np.zeros((BUCKETS, classes), dtype=np.float32), _prior(y, classes, weight).astype(np.float32)
    adam, rng, mean = _Adam([w, b], 0.1), np.random.default_rng(5), max(weight.mean() if len(weight) else 0.0, 1e-9)
    for epoch in range(epochs):
        adam.rate = 0.1 * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            owner, bucket, value = x.entries(rows)
            z = np.column_stack([np.bincount(owner, value * w[bucket, c], minlength=len(rows)) for c in range(classes)]) + b
            g = _softmax(z)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= (weight[rows] / (mean * len(rows)))[:, None]
            gw = np.column_stack([np.bincount(bucket, value * g[owner, c], minlength=BUCKETS) for c in range(classes)])
            adam.step([(gw + decay * w / classes).astype(np.float32), g.sum(axis=0).astype(np.float32)])
    return w, b


def sparse_logits(w: np.ndarray, b: np.ndarray, bucket: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class logits of texts from their trigram buckets."""
    n = np.maximum(np.diff(offsets), 1)
    return np.column_stack([_sums(w[bucket, k], offsets) * SCALE / n for k in range(w.shape[1])]) + b
