"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters with word inputs (how much likelier it is in toxic training rows, an embedding) and character inputs (the same over its byte
7-grams, ends marked). Windows of ``WINDOW`` words, each half over the next, run through a gated recurrent unit in either direction; attention pools the
states to one logit. A text's score comes from its most toxic window and from the mean over all its windows. In training only the most toxic window of a row
passes on its error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textmodel import some_ids
from .textops import NO_WORD, Words, chunks, mix

WINDOW, STRIDE = 16, 8
HIDDEN = 8
EMBED = 4
GRAM = 7
ODDS_BITS, EMBED_BITS = 18, 14
FIXED = 3
INPUTS = FIXED + 2 * EMBED
MAX_LABELLED = 8000
MAX_BYTES = 200_000  # longer texts aren't taken for training; all are scored
MAX_TOTAL = 32 << 20  # bytes of all texts taken for training
EPOCHS = 10
DROPPED = 0.5  # share of words without their embeddings in a training step
BLOCK = 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> F.Column:
    """Whether a row is kept out of training: CRC-32 of its id as text, modulo 5, is 0; so it is for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Vocabulary:
    """The different words of some texts, with the keys of their byte 7-grams; ``tokens`` are places in it."""

    def __init__(self, words: Words):
        self.keys, first, self.tokens = np.unique(words.hashes(), return_index=True, return_inverse=True)
        starts, lengths = words.starts[first], words.ends[first] - words.starts[first]
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        begin = np.concatenate(([0], np.cumsum(lengths + GRAM)))
        buffer = np.full(begin[-1], 3, dtype=np.uint64)
        buffer[begin[:-1]] = 2
        inner = np.arange(lengths.sum()) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths, lengths)
        buffer[np.repeat(begin[:-1] + 1, lengths) + inner] = words.data[np.repeat(starts, lengths) + inner]
        key = buffer.copy()
        for k in range(1, GRAM):
            key[:-k] |= buffer[k:] << np.uint64(8 * k)
        at = np.arange(self.offsets[-1]) + np.repeat(np.arange(len(lengths)) * (GRAM - 1), lengths + 1)
        self.grams = mix(key[at])

    def pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The different words of each text: text and place."""
        owner = np.repeat(np.arange(len(words)), np.diff(words.bounds))
        both = np.unique(owner * len(self.keys) + self.tokens) if len(self.keys) else owner
        return (both // len(self.keys), both % len(self.keys)) if len(self.keys) else (both, both)


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _MULT) >> np.uint64(64 - bits)).astype(np.int64)


def _ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen rows' entries and which of the rows each belongs to."""
    n = offsets[rows + 1] - offsets[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum()), owner


class Odds:
    """How much likelier a row is toxic that has a word, and one that has a byte gram, than any row; shrunk by rarity."""

    def __init__(self):
        self.n = np.zeros((2, 2, 1 << ODDS_BITS))
        self.rows = np.zeros(2)

    def add(self, words: Words, y: np.ndarray) -> None:
        v = Vocabulary(words)
        self.rows += np.bincount(y, minlength=2)
        text, word = v.pairs(words)
        at, owner = _ragged(v.offsets, word)
        for k, (t, bucket) in enumerate(((text, _top(v.keys[word], ODDS_BITS)), (text[owner], _top(v.grams[at], ODDS_BITS)))):
            both = np.unique((t << ODDS_BITS) + bucket)
            for label in (0, 1):
                self.n[k, label] += np.bincount(both[y[both >> ODDS_BITS] == label] & ((1 << ODDS_BITS) - 1), minlength=1 << ODDS_BITS)

    def finish(self) -> np.ndarray:
        share = min(0.99, max(0.01, self.rows[1] / max(1, self.rows.sum())))
        p = (self.n[:, 1] + 5 * share) / (self.n.sum(axis=1) + 5)
        return (np.log(p / (1 - p)) - np.log(share / (1 - share))).astype(np.float32)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token places (row by row), which of them are in the text, and the text of every window; an empty text has one without words."""
    n = np.diff(words.bounds)
    each = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), each)
    place = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each)
    at = (words.bounds[text] + place * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < words.bounds[text + 1][:, None]
    return np.where(inside, at, 0), inside, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The network's weights; ``odds`` are fixed, all else is trained."""

    def __init__(self, odds: np.ndarray):
        rng = np.random.default_rng(7)
        small = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        self.odds = odds
        self.p = {
            "word": small(1 << EMBED_BITS, EMBED) * 0.1, "char": small(1 << EMBED_BITS, EMBED) * 0.1,
            "a": small(2 * HIDDEN, HIDDEN), "a0": np.zeros(HIDDEN, np.float32), "v": small(HIDDEN), "o": small(2 * HIDDEN), "o0": np.zeros(1, np.float32) - 1,
        }
        for k in "fb":
            self.p |= {f"w{k}": small(INPUTS, 3 * HIDDEN), f"b{k}": np.zeros(3 * HIDDEN, np.float32), f"u{k}": small(HIDDEN, 3 * HIDDEN)}
        self.scale = np.array([0.0, 0.0, -2.0])  # of the largest logit, of the mean, and a constant; untrained, all texts score alike

    def inputs(self, v: Vocabulary, rows: np.ndarray | None = None):
        """Input vectors of words and what the gradient of their embeddings needs."""
        rows = np.arange(len(v.keys)) if rows is None else rows
        at, owner = _ragged(v.offsets, rows)
        n = np.maximum(np.bincount(owner, minlength=len(rows)), 1).astype(np.float32)
        cut = v.offsets[rows + 1] - v.offsets[rows]
        first = np.concatenate(([0], np.cumsum(cut)[:-1])).astype(np.int64) if len(cut) else cut
        x = np.zeros((len(rows), INPUTS), dtype=np.float32)
        if len(rows):
            gram = self.odds[1][_top(v.grams[at], ODDS_BITS)]
            x[:, 0] = self.odds[0][_top(v.keys[rows], ODDS_BITS)]
            x[:, 1] = np.maximum.reduceat(gram, first)
            x[:, 2] = np.add.reduceat(gram, first) / n
        word, char = _top(v.keys[rows], EMBED_BITS), _top(v.grams[at], EMBED_BITS)
        x[:, FIXED : FIXED + EMBED] = self.p["word"][word]
        for k in range(EMBED):
            x[:, FIXED + EMBED + k] = np.bincount(owner, self.p["char"][char, k], minlength=len(rows)) / n
        return x, (word, char, owner, n)

    def _step(self, k: str, xp: np.ndarray, h: np.ndarray, m: np.ndarray):
        hp = h @ self.p[f"u{k}"]
        zr = _sigmoid(xp[:, : 2 * HIDDEN] + hp[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(xp[:, 2 * HIDDEN :] + r * hp[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        return np.where(m[:, None], new, h), (h, z, r, c, hp[:, 2 * HIDDEN :])

    def logits(self, projected: dict, tokens: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """A logit for each window of places in the vocabulary, from the words' projected inputs."""
        out = np.zeros(len(tokens), dtype=np.float32)
        for a in range(0, len(tokens), BLOCK):
            own, m = tokens[a : a + BLOCK], inside[a : a + BLOCK]
            states = np.zeros((WINDOW, len(own), 2 * HIDDEN), dtype=np.float32)
            for d, (k, order) in enumerate((("f", range(WINDOW)), ("b", reversed(range(WINDOW))))):
                h = np.zeros((len(own), HIDDEN), dtype=np.float32)
                for t in order:
                    h, _ = self._step(k, projected[k][own[:, t]], h, m[:, t])
                    states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
            out[a : a + BLOCK] = self._pool(states, m.T)[0]
        return out

    def _pool(self, states: np.ndarray, m: np.ndarray):
        u = np.tanh(states @ self.p["a"] + self.p["a0"])
        e = np.where(m, np.exp(np.clip(u @ self.p["v"], -20, 20)), 0)
        w = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, states)
        return pooled @ self.p["o"] + self.p["o0"], (u, w, pooled)

    def projected(self, v: Vocabulary) -> dict:
        x, _ = self.inputs(v)
        return {k: x @ self.p[f"w{k}"] + self.p[f"b{k}"] for k in "fb"} if len(x) else {k: np.zeros((1, 3 * HIDDEN), np.float32) for k in "fb"}

    def gradients(self, v: Vocabulary, tokens: np.ndarray, inside: np.ndarray, y: np.ndarray, weight: np.ndarray, rng=None) -> dict:
        """Gradients of the weighted logistic loss over one window for each row; with ``rng`` some words go without embeddings."""
        p, n = self.p, len(tokens)
        rows, back = np.unique(tokens, return_inverse=True)
        back = back.reshape(tokens.shape)
        x, (word, char, owner, count) = self.inputs(v, rows)
        on = np.ones(len(rows), np.float32) if rng is None else (rng.random(len(rows)) >= DROPPED).astype(np.float32)
        x[:, FIXED:] *= on[:, None]
        states, kept = np.zeros((WINDOW, n, 2 * HIDDEN), dtype=np.float32), {}
        for d, (k, order) in enumerate((("f", range(WINDOW)), ("b", reversed(range(WINDOW))))):
            xp, h = x @ p[f"w{k}"] + p[f"b{k}"], np.zeros((n, HIDDEN), dtype=np.float32)
            for t in order:
                h, kept[k, t] = self._step(k, xp[back[:, t]], h, inside[:, t])
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        z, (u, w, pooled) = self._pool(states, inside.T)
        dz = (_sigmoid(z) - y) * weight / max(weight.sum(), 1e-9)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["o"], g["o0"] = pooled.T @ dz, dz.sum(keepdims=True)
        d_pooled = np.outer(dz, p["o"])
        d_states = w[:, :, None] * d_pooled
        dw = np.einsum("nh,tnh->tn", d_pooled, states)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["a"], g["a0"] = np.einsum("tni,tnj->ij", states, du), du.sum(axis=(0, 1))
        d_states += du @ p["a"].T
        dx = np.zeros_like(x)
        for d, (k, order) in enumerate((("f", reversed(range(WINDOW))), ("b", range(WINDOW)))):
            dh, dxp = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((len(rows), 3 * HIDDEN), dtype=np.float32)
            for t in order:
                dh = dh + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                h, zt, r, c, hc = kept[k, t]
                m = inside[:, t][:, None]
                own = np.where(m, dh, 0)
                dc = own * (1 - zt) * (1 - c * c)
                dzt, dr = own * (h - c) * zt * (1 - zt), dc * hc * r * (1 - r)
                flat, hidden = np.hstack([dzt, dr, dc]), np.hstack([dzt, dr, dc * r])
                g[f"u{k}"] += h.T @ hidden
                np.add.at(dxp, back[:, t], flat)
                dh = np.where(m, own * zt + hidden @ p[f"u{k}"].T, dh)
            g[f"w{k}"], g[f"b{k}"] = x.T @ dxp, dxp.sum(axis=0)
            dx += dxp @ p[f"w{k}"].T
        dx[:, FIXED:] *= on[:, None]
        np.add.at(g["word"], word, dx[:, FIXED : FIXED + EMBED])
        np.add.at(g["char"], char, (dx[:, FIXED + EMBED :] / count[:, None])[owner])
        return g

    def train(self, words: Words, y: np.ndarray, aside: Words | None = None, aside_y: np.ndarray | None = None) -> None:
        """Adam over the most toxic window of each row, chosen anew in every epoch; toxic rows weigh as much as the others together.

        The weights of the epoch that ranks the rows aside best are kept.
        """
        best_auc, best_p = -1.0, self.p
        v = Vocabulary(words)
        at, inside, text = windows(words)
        tokens = v.tokens[at] if len(v.tokens) else at
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in self.p.items()}
        rng, step = np.random.default_rng(11), 0
        for _ in range(EPOCHS):
            best = self.most(self.logits(self.projected(v), tokens, inside), text)[1]
            for _ in range(3):
                order = rng.permutation(len(y))
                for a in range(0, len(y), 128):
                    own = order[a : a + 128]
                    step += 1
                    for k, d in self.gradients(v, tokens[best[own]], inside[best[own]], y[own], weight[own], rng).items():
                        m, s = moments[k]
                        m += 0.1 * (d + 1e-4 * self.p[k] - m)
                        s += 0.01 * (d * d - s)
                        self.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if aside is not None and 0 < aside_y.sum() < len(aside_y):
                auc = _auc(self.evidence(aside)[:, 1], aside_y)
                if auc > best_auc:
                    best_auc, best_p = auc, {k: a.copy() for k, a in self.p.items()}
        if best_auc >= 0:
            self.p = best_p

    @staticmethod
    def most(z: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest logit of each text and its window."""
        order = np.lexsort((z, text))
        last = np.flatnonzero(np.diff(text[order], append=-1) != 0)
        return z[order[last]], order[last]

    def evidence(self, words: Words) -> np.ndarray:
        """The largest logit of each text's windows, the log of their mean probability (drawn to 0.01 by three more windows), and 1."""
        v = Vocabulary(words)
        at, inside, text = windows(words)
        z = self.logits(self.projected(v), v.tokens[at] if len(v.tokens) else at, inside)
        mean = (np.bincount(text, _sigmoid(z), minlength=len(words)) + 0.03) / (np.bincount(text, minlength=len(words)) + 3)
        return np.column_stack([self.most(z, text)[0], np.log(mean), np.ones(len(words))]).astype(np.float64)

    def scores(self, words: Words) -> np.ndarray:
        """Calibrated logit of every text."""
        return self.evidence(words) @ self.scale


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def _joined(texts: list[bytes]) -> Words:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, NO_WORD)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on at most ``MAX_LABELLED`` labelled rows that aren't held out, chosen by a hash of the id, of texts up to ``MAX_BYTES`` and ``MAX_TOTAL`` bytes in all.

    Odds come from one half of them and the network from most of the other, so that it meets odds as it will on new rows; of the rest some choose the epoch and
    others set the scale of scores. Labels other than 0 and 1 are ignored; of several labels of an id the highest holds.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.where(~held_out(F.col("doc_id")) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES))
    chosen = some_ids(short.select("doc_id").join(known, "doc_id"), MAX_LABELLED)
    rows = short.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id")
    # bytes up to each id, in order of the hash: at most MAX_LABELLED ids
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.join(F.broadcast(sizes.withColumn("total", total).where(F.col("total") <= MAX_TOTAL).select("doc_id")), "doc_id", "left_semi")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_LABELLED)
    table = rows.select("text", "toxic").toArrow()
    texts, y = table.column("text").to_pylist(), table.column("toxic").to_numpy().astype(np.int64)
    del table
    odds = Odds()
    for a in range(0, len(texts) // 2, 200):
        own = slice(a, min(a + 200, len(texts) // 2))
        odds.add(_joined(texts[own]), y[own])
    network = Network(odds.finish())
    rest = np.arange(len(texts) // 2, len(texts))
    train, aside = rest[rest % 10 < 7], rest[rest % 10 >= 7]
    choosing, scaling = aside[aside % 2 == 0], aside[aside % 2 == 1]
    if not all(0 < y[a].sum() < len(a) for a in (choosing, scaling)):
        choosing = scaling = aside
    if len(train) and 0 < y[train].sum() < len(train):
        network.train(_joined([texts[k] for k in train]), y[train], _joined([texts[k] for k in choosing]), y[choosing])
        network.scale = np.array([1.0, 0.0, 0.0])
    if len(scaling) and 0 < y[scaling].sum() < len(scaling):
        network.scale = _logistic(network.evidence(_joined([texts[k] for k in scaling])), y[scaling])
    return network


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly damped logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (q - y) + 0.1 * w)
    return w


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, held_out, score`` (0 to 1) and ``predicted`` for every row of ``docs(doc_id, text, ...)``, over all windows of its whole text.

    Nothing but the text enters a score. A null text is an empty one, which has one window without words. Repeated rows and null ids come back as they are
    (a null id counts as held out); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            z = [shared.value.scores(words) for _, words in chunks(batch.column(2), NO_WORD)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z or [np.zeros(0)]), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
