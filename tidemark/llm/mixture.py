"""Operator 6: mixing to target weights by soft membership.

A classifier fitted on labelled rows gives every document a probability for each domain. Nonnegative document rates are then fitted so that
the expected token totals of the domains match their targets: least squares by accelerated projected gradient, scaled by the inverse of the domains' matrix of
products, so that a few passes do. In an iteration each task replays the few numbers all earlier gradients consist of and adds up its own totals, so no rates
are stored or moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textmodel import _softmax, fit_sparse, sampled, sparse_logits, trigrams
from .textops import chunks

MAX_LABELLED = 1500
ITERATIONS = 40
RIDGE = 1e-3  # damps the steps of domains that hardly occur
CLOSE = 1e-4  # share of all tokens by which domain totals may miss
ROOM = 1.02  # how much larger than it must be a mixture is that leaves no document out


class Domains:
    """A softmax over hashed byte trigrams."""

    def __init__(self, names: list[str], sample: dict):
        self.names = names
        y = np.array([names.index(d) for d in sample["domain"]], dtype=np.int64)
        self.w, self.b = fit_sparse(sample["trigrams"], y, len(names), np.ones(len(y)))


def fit_domains(labelled: DataFrame) -> Domains:
    """Fit on ``labelled(doc_id, text, domain)``, on ``MAX_LABELLED`` rows at most, chosen by a hash; null domains are ignored."""
    sample = sampled(labelled.where("domain IS NOT NULL").select("doc_id", "domain", "text"), MAX_LABELLED, ("doc_id", "domain"))
    return Domains(sorted(set(sample["domain"])) or ["all"], sample)


def memberships(docs: DataFrame, model: Domains, rates=None, text: str = "text") -> DataFrame:
    """``tokens`` (words) and ``domains`` (probabilities) beside all columns of ``docs(text, ...)``; null texts are empty and have 0 tokens.

    ``rates``, a function of the matrix of probabilities, adds a column ``rate`` in the same pass; ``text`` names the column with texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("tokens", "domains", "rate")
    columns = docs.columns
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            tokens, parts = [np.zeros(0, np.int64)], [np.zeros((0, len(shared.value.names)))]
            for _, words in chunks(batch.column(place)):
                tokens.append(np.diff(words.bounds))
                parts.append(_softmax(sparse_logits(shared.value.w, shared.value.b, *trigrams(words))))
            p = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            more = {"tokens": pa.array(np.concatenate(tokens)), "domains": lists} | ({"rate": pa.array(rates(p))} if rates else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*columns, *more])

    added = "tokens long, domains array<double>" + ", rate double" * bool(rates)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])
    return docs.mapInArrow(run, kinds)


def _replay(p: np.ndarray, history: list[np.ndarray], base: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and the extrapolated point after the gradients so far, of rows with memberships ``p``; each step is projected on rates of ``least`` or more."""
    rate = point = np.full(len(p), base)
    t = 1.0
    for e in history:
        step = np.maximum(least, point - p @ e)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point = np.maximum(least, step + (t - 1) / after * (step - rate))
        rate, t = step, after
    return rate, point


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)


def fit_rates(rows: DataFrame, targets: list[float], base: float, least: float = 0.0) -> list[np.ndarray]:
    """Gradients that lead to rates of ``least`` or more whose domain totals over ``rows(tokens, domains)`` are ``targets`` (tokens), starting at ``base``."""
    k = len(targets)
    goal = np.array(targets)
    total = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    history: list[np.ndarray] = []
    if not total:
        return history

    def totals(past):
        def run(batches):
            got, rates, both = np.zeros(k), np.zeros(k), np.zeros((k, k))
            for batch in batches:
                p, n = _matrix(batch.column(1), k), batch.column(0).to_numpy()
                rate, point = _replay(p, past, base, least)
                got += (n * point) @ p
                rates += (n * rate) @ p
                both += (p * n[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()]) for x in (got, rates, both)], names=["point", "rate", "both"])

        sums = rows.select("tokens", "domains").mapInArrow(run, "point array<double>, rate array<double>, both array<double>")
        sums = np.array(sums.agg(*(F.sum(F.col(c)[j]) for c, m in (("point", k), ("rate", k), ("both", k * k)) for j in range(m))).first(), dtype=float)
        return sums[:k], sums[k : 2 * k], sums[2 * k :].reshape(k, k)

    for _ in range(ITERATIONS):
        at_point, at_rate, both = totals(history)
        if np.abs(at_rate - goal).max() <= CLOSE * total:
            break
        history.append(np.linalg.solve(both / total + RIDGE * np.eye(k), (at_point - goal) / total))
    return history


def mixed(docs: DataFrame, model: Domains, weights: dict[str, float], whole: bool = False, read: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with ``tokens, domains, rate, copies``: how often a document is to be taken for the domains to have ``weights``.

    Token totals stay as large as they are; with ``whole`` rates are fitted under the bound of 1, so that mixing repeats documents and leaves none out, and totals
    grow by as much as the domain with the most tokens for its weight needs. ``copies`` is ``rate`` rounded down or up, by a hash of the row, as often as its fraction
    says. Domains without a weight get none. Documents without tokens have a rate and no influence. Null texts are empty; repeated rows
    are rows of their own and get the same copies; an empty table gives an empty result. Other columns stay; those named as results are replaced.
    ``read`` names the columns with ids and texts.
    """
    doc_id, text = read
    docs = docs.drop("rate", "copies")
    rows = stored(memberships(docs.select(text), model, text=text).select("tokens", "domains"), "members")
    k = len(model.names)
    have = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *(F.sum(F.col("tokens") * F.col("domains")[j]) for j in range(k))).first()
    want = np.array([max(0.0, weights.get(d, 0.0)) for d in model.names])
    if want.sum() <= 0:
        want = np.ones(k)
    want /= want.sum()
    total, per = float(have[0]), np.array([float(x or 0) for x in have[1:]])
    size = max(total, ROOM * float((per[want > 0] / want[want > 0]).max())) if whole else total
    base, least = (size / total if total else 1.0), float(whole)
    history = fit_rates(rows, list(size * want), base, least)

    def rates(p: np.ndarray) -> np.ndarray:
        return _replay(p, history, base, least)[0]

    rated = memberships(docs, model, rates, text)
    luck = F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)) / F.lit(1 << 20)
    return rated.withColumn("copies", F.floor(F.col("rate") + luck).cast("int"))
