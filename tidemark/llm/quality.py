"""Operator 9: a quality classifier by co-training.

Two views of a document are fitted apart: its text (hashed byte trigrams) and its page metadata (language, source, length and layout
figures). In each round both views score all unlabelled documents, and each labels the share ``TAKEN`` of the whole table that it is surest of,
for the other view to learn from. Both views are then calibrated on labelled rows kept aside and combined, and every document is scored.

The surest share grows with the table and is found by counts over steps of 1/64 of a margin. Training takes up to ``PSEUDO`` of its rows a view and round
(and one more a class), those least by a hash of the id; the very surest alone would be much alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textmodel import BUCKETS, LAYOUT, fit_dense, fit_sparse, sampled, some_ids, sparse_logits, views

MAX_LABELLED = 4000
ROUNDS = 3
TAKEN = 0.05  # share of the unlabelled rows that each view labels in a round, divided between the classes as the labelled rows are
PSEUDO = 150  # of these that training takes
STEPS, EDGE = 64, 32  # of margins: steps in one, the margin from which on all are equally sure
KINDS = 24
RARE = 0.05  # least spread of a bucket's column


def metadata(figures: np.ndarray, lang: list, source: list, n_chars: list) -> np.ndarray:
    """Layout figures with the columns of the table: 8 buckets of language, 16 of source, and the stated length."""
    hot = np.zeros((len(figures), KINDS + 1))
    for k, (a, s, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        hot[k, zlib.crc32(str(a).encode()) % 8] = 1
        hot[k, 8 + zlib.crc32(str(s).encode()) % 16] = 0.3
        hot[k, KINDS] = np.log1p(max(0, n or 0)) / 5
    return np.hstack([figures, hot])


class CoTrained:
    """Weights of both views and of their calibrated combination; ``score`` is the probability of good quality.

    ``surest(model, view, share)`` gives features of unlabelled rows that the other view of the model so far is surest of, none twice, with their
    pseudo-labels ``quality``; ``share`` is that of good quality.
    """

    def __init__(self, labelled: dict, surest):
        y = np.array(labelled["quality"], dtype=np.int64)
        if len(set(y.tolist())) < 2:  # nothing to tell apart: every document is kept
            self.mean, self.std = np.zeros(LAYOUT + KINDS + 1), np.ones(LAYOUT + KINDS + 1)
            self.text, self.meta = (np.zeros((BUCKETS, 2)), np.zeros(2)), (np.zeros((LAYOUT + KINDS + 1, 2)), np.zeros(2))
            self.mix, self.bias, self.each = np.zeros(2), 0.0, [(1.0, 0.0)] * 2
            return
        fold = np.arange(len(y)) % 4 == 3  # kept aside for calibration
        rows, aside = np.flatnonzero(~fold), np.flatnonzero(fold)
        own = self._metadata(labelled)
        self.mean, self.std = own.mean(axis=0), own.std(axis=0) + 1e-3
        self.std[LAYOUT : LAYOUT + KINDS] = np.maximum(self.std[LAYOUT : LAYOUT + KINDS], RARE)  # a source no labelled row has must not count a hundredfold
        meta = (own - self.mean) / self.std
        share = y[rows].mean()
        text_rows, meta_rows, labels = labelled["trigrams"].take(rows), meta[rows], [[], []]  # what the views learn from, and pseudo-labels
        for step in range(ROUNDS + 1):
            self.text = fit_sparse(text_rows, *self._rows(y[rows], labels[0]))
            self.meta = fit_dense(meta_rows, *self._rows(y[rows], labels[1]), decay=1e-3)
            if step == ROUNDS:
                break
            for view, more in enumerate(surest(self, view, share) for view in (0, 1)):
                labels[view] += more["quality"]
                if view == 0:
                    text_rows = text_rows.joined(more["trigrams"])
                else:
                    meta_rows = np.vstack([meta_rows, (self._metadata(more) - self.mean) / self.std])
        self.pseudo = tuple(map(len, labels))
        both = np.column_stack([labelled["trigrams"].take(aside).margins(*self.text), self._meta_z(meta[aside])])
        w, b = fit_dense(both, y[aside], 2, np.ones(len(aside)), decay=1e-2) if len(aside) else (np.array([[-0.5, 0.5]] * 2), np.zeros(2))
        self.mix, self.bias = np.maximum(w[:, 1] - w[:, 0], 0), b[1] - b[0]
        self.each = []
        for k in range(2):  # each view's own calibration
            w, b = fit_dense(both[:, [k]], y[aside], 2, np.ones(len(aside)), decay=1e-2) if len(aside) else (np.array([[-0.5, 0.5]]), np.zeros(2))
            self.each.append((max(0.0, float(w[0, 1] - w[0, 0])), float(b[1] - b[0])))

    @staticmethod
    def _metadata(found: dict) -> np.ndarray:
        return metadata(found["layout"], found["lang"], found["source"], found["n_chars"])

    @staticmethod
    def _rows(y, pseudo):
        return np.concatenate([y, np.array(pseudo, dtype=np.int64)]), 2, np.concatenate([np.ones(len(y)), np.full(len(pseudo), 0.5)])

    def _meta_z(self, x):
        w, b = self.meta
        return x @ (w[:, 1] - w[:, 0]) + b[1] - b[0]

    def margins(self, bucket, offsets, figures, lang, source, n_chars) -> np.ndarray:
        """Logits of good quality by text and by metadata."""
        z = sparse_logits(*self.text, bucket, offsets)
        return np.column_stack([z[:, 1] - z[:, 0], self._meta_z((metadata(figures, lang, source, n_chars) - self.mean) / self.std)])

    def score(self, *page) -> np.ndarray:
        """Probabilities of good quality: by text, by metadata, by both."""
        z = self.margins(*page)
        by = [a * z[:, k] + b for k, (a, b) in enumerate(self.each)]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([*by, z @ self.mix + self.bias]), -40, 40)))


def _pages(batch: pa.RecordBatch, places: list[int], of) -> np.ndarray:
    """``of(bucket, offsets, figures, lang, source, n_chars)`` of all rows of a batch; ``places`` are the columns of text, language, source and length."""
    text, *rest = (batch.column(k) for k in places)
    rest = [c.to_pylist() for c in rest]
    at, parts = 0, []
    for bucket, offsets, figures in views(text):
        parts.append(of(bucket, offsets, figures, *(c[at : at + len(figures)] for c in rest)))
        at += len(figures)
    return np.concatenate(parts) if parts else np.zeros((0, 3))


def _reached(counts: list[tuple[int, int]], wanted: float) -> int:
    """The first step at which as many rows as ``wanted`` have been counted."""
    total = 0
    for step, n in counts:
        total += n
        if total >= wanted:
            break
    return step if counts else 0


class _Surest:
    """The unlabelled rows of a table that each view is surest of, round by round; the driver gets no more than training takes."""

    def __init__(self, docs: DataFrame, known: DataFrame):
        self.docs, self.known, self.scored, self.of = docs, known, None, None
        self.taken: list[set] = [set(), set()]

    def __call__(self, model: CoTrained, view: int, share: float) -> dict:
        if view == 0:
            self.scored = self._margins(model)
        left = self.scored.withColumn("step", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z_meta" if view == 0 else "z_text") / EDGE)) * EDGE * STEPS))
        if self.taken[view]:
            left = left.join(F.broadcast(self._ids(self.taken[view])), "doc_id", "left_anti")
        counts = sorted((r[0], r[1]) for r in left.groupBy("step").agg(F.count("*")).collect())  # one for each step of margins
        wanted = [share_of * TAKEN * sum(n for _, n in counts) for share_of in (1 - share, share)]
        bad, good = _reached(counts, wanted[0]), _reached(counts[::-1], wanted[1])
        step, found = F.col("step"), {}
        for label, own in ((0, (step <= bad) & (step < 0)), (1, (step >= good) & (step >= 0))):
            rows = left.where(own).orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(PSEUDO * (share if label else 1 - share)) + 1)
            found |= {r[0]: label for r in rows.select("doc_id").collect()}
        self.taken[view] |= set(found)
        rows = self.docs.join(F.broadcast(self._ids(found)), "doc_id", "left_semi").dropDuplicates(["doc_id"]) if found else self.docs.limit(0)
        got = sampled(rows, 2 * PSEUDO, ("doc_id", "lang", "source", "n_chars"))
        return got | {"quality": [found[i] for i in got["doc_id"]]}

    def _ids(self, ids) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], self.docs.select("doc_id").schema)

    def _margins(self, model: CoTrained) -> DataFrame:
        """``doc_id, z_text, z_meta`` of all unlabelled rows; equal ids count once, at their lowest margins."""
        shared = self.docs.sparkSession.sparkContext.broadcast(model)
        kind = self.docs.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                z = _pages(batch, [1, 2, 3, 4], shared.value.margins)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z[:, 0]), pa.array(z[:, 1])], names=["doc_id", "z_text", "z_meta"])

        found = self.docs.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, f"doc_id {kind}, z_text double, z_meta double")
        found = found.groupBy("doc_id").agg(F.min("z_text").alias("z_text"), F.min("z_meta").alias("z_meta"))
        return stored(found.join(self.known, "doc_id", "left_anti"), "margins")


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on ``MAX_LABELLED`` labelled rows at most, chosen by a hash of the id, and on all others as the module says.

    Labels other than 0 and 1 and rows without an id are ignored; of several labels for one id the lowest holds.
    """
    keep = ("doc_id", "lang", "source", "n_chars")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    base = docs.select(*keep, "text")
    labelled = sampled(base.join(some_ids(docs.select("doc_id").join(known, "doc_id"), MAX_LABELLED), "doc_id"), MAX_LABELLED, (*keep, "quality"))
    return CoTrained(labelled, _Surest(base, known.select("doc_id")))


def score(docs: DataFrame, model: CoTrained, read: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """Every row of ``docs(doc_id, text, lang, source, n_chars, ...)`` with ``text_score, meta_score, score`` (probability of good quality) and ``kept``.

    ``kept`` is a score of 0.5 or more; ``read`` names the columns with text, language, source and length. All columns stay, in one pass without a shuffle.
    Null texts are empty; null languages, sources and lengths have a bucket of their own (length 0); repeated rows stay repeated; an empty table gives an
    empty result. Columns of ``docs`` with the names of the results are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ("text_score", "meta_score", "score", "kept")
    docs = docs.drop(*names)
    columns = docs.columns
    places = [columns.index(c) for c in read]

    def run(batches):
        for batch in batches:
            got = _pages(batch, places, shared.value.score)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, k]) for k in range(3)), pa.array(got[:, 2] >= 0.5)], names=[*columns, *names])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "text_score double, meta_score double, score double, kept boolean"])
    return docs.mapInArrow(run, kinds)
