"""Operator 2: language-model scores by prediction by partial matching (PPM) over bytes.

A trie of byte contexts of up to ``ORDER`` bytes is counted over all training texts. A byte is coded in the
longest context the trie has; where it has not followed, an escape (as likely as the context has different
successors) leads to the context one byte shorter, in which the successors already ruled out are excluded. ``ORDER``
zero bytes stand before a text and one behind it, so its end is coded too.

The counts of the longest grams hold all shorter ones. The trie lies in shards by the two bytes before the coded one, each with all
grams of its contexts; orders 0 and 1, 65,792 grams at most, are counted over all shards and known to each. A shard gives the value of
each different gram of its contexts, whether trained or only asked. What is broadcast is bounded: the values of ``MAX_GRAMS`` grams at most,
the most frequent ones, and, for the base score, words that make up more than one in ``2**20`` of all tokens; all other grams and words are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions, stored
from .textops import Lookup, Words, chunks, mix, signed, tallied

ORDER = 5
MAX_GRAMS = 1 << 22
SHARD_GRAMS = 200_000
MERGE_AT = 1_000_000
FREQUENT_BITS = 20
WORD, GRAM = 0, 1
END = int(mix(np.array([0x656E64], dtype=np.uint64))[0])  # the key of the end token


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``ORDER`` + 1 bytes that end at each byte and at the end of each text, and where each text's begin."""
    lengths = np.diff(words.offsets)
    n = len(lengths)
    places = np.arange(len(words.raw)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, lengths)
    padded = np.zeros(len(words.raw) + n * (ORDER + 1), dtype=np.uint64)
    padded[places] = words.raw
    key = padded.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= padded[:-k] << np.uint64(8 * k)
    coded = np.ones(len(padded), dtype=bool)
    first = words.offsets[:-1] + np.arange(n) * (ORDER + 1)
    for k in range(ORDER):
        coded[first + k] = False
    return key[coded], words.offsets[:-1] + np.arange(n)


def counted(docs: DataFrame) -> DataFrame:
    """``(kind, key, n)``: how often each word and each longest gram occurs in all texts of ``docs(text)``."""

    def run(batches):
        parts = {WORD: [], GRAM: []}
        texts = 0

        def add(kind, keys):
            keys, n = np.unique(keys, return_counts=True)
            parts[kind].append((keys, n))
            if sum(len(k) for k, _ in parts[kind][1:]) > MERGE_AT:
                parts[kind] = [tallied(parts[kind])]

        for batch in batches:
            texts += batch.num_rows
            for _, words in chunks(batch.column(0)):
                add(WORD, words.hashes())
                add(GRAM, grams(words)[0])
        if texts:
            parts[WORD].append((np.array([END], dtype=np.uint64), np.array([texts])))
        for kind, got in parts.items():
            keys, n = tallied(got)
            for k in range(0, len(keys), 1 << 16):
                own = keys[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int8)), signed(own), pa.array(n[k : k + (1 << 16)].astype(np.int64))], names=["kind", "key", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Log10 code lengths of a counted trie, by order: of a gram, of an escape, and of both under exclusion.

    ``keys`` and ``n`` are all grams of some contexts of two bytes; ``low`` the keys and counts of order 1 over all contexts.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]):
        self.orders = []
        below = None
        tables = []
        for k in range(ORDER, -1, -1):
            if k == 1:
                keys, n = low
            keys, n = tallied([(keys & np.uint64((1 << (8 * (k + 1))) - 1), n)])
            tables.append((k, keys, n))
        for k, keys, n in reversed(tables):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.diff(context, prepend=~context[:1]) != 0)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(keys)))
            owner = np.repeat(np.arange(len(first)), kinds)
            own = {
                "gram": Lookup(keys),
                "context": Lookup(context[first]),
                "log_n": np.log10(n),
                "direct": np.log10(n / (total + kinds)[owner]),
                "escape": np.log10(kinds / (total + kinds)),
            }
            if below is not None:
                b_keys, b_n, b_context, b_total, b_kinds = below
                short = np.uint64((1 << (8 * k)) - 1)
                taken = np.add.reduceat(b_n[np.searchsorted(b_keys, keys & short)], first)
                parent = np.searchsorted(b_context, context[first] & (short >> np.uint64(8)))
                rest = b_kinds[parent] - kinds
                room = b_total[parent] - taken + rest
                own["room"] = np.log10(np.maximum(room, 1))
                own["escape_excluded"] = np.where(rest > 0, np.log10(np.maximum(rest, 1)) - own["room"], 0.0)
            below = keys, n, context[first], total, kinds
            self.orders.append({a: x.astype(np.float32) if isinstance(x, np.ndarray) else x for a, x in own.items()})
        self.unseen = -float(np.log10(max(1, 256 - len(tables[-1][1]))))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        ruled = np.full(len(keys), -1)  # the longer context whose successors are excluded
        for k in range(ORDER, -1, -1):
            own, own_keys = self.orders[k], keys[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            above = self.orders[k + 1] if k < ORDER else None
            at = own["gram"].find(own_keys)
            hit = np.flatnonzero(at >= 0)
            value = own["direct"][at[hit]].astype(np.float64)
            if above is not None:
                excluded = ruled[hit] >= 0
                value[excluded] = own["log_n"][at[hit[excluded]]] - above["room"][ruled[hit[excluded]]]
            out[left[hit]] += value
            miss = np.flatnonzero(at < 0)
            left, ruled, own_keys = left[miss], ruled[miss], own_keys[miss]
            context = own["context"].find(own_keys >> np.uint64(8))
            known = context >= 0
            fresh = known & (ruled < 0)
            out[left[fresh]] += own["escape"][context[fresh]]
            if above is not None:
                again = known & (ruled >= 0)
                out[left[again]] += above["escape_excluded"][ruled[again]]
            ruled = context
            if not len(left):
                return out
        out[left] += self.unseen
        return out


def _values(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n, value``: how often each gram of ``asked(kind, key, n)`` occurs there and its log10 probability under the trie of ``counts``."""
    grams_of = lambda df: df.where(F.col("kind") == GRAM)
    order_1 = grams_of(counts).groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = asked.sparkSession.sparkContext.broadcast((order_1.column("key").to_numpy().view(np.uint64), order_1.column("n").to_numpy()))

    def run(table: pa.Table) -> pa.Table:
        keys, trained = table.column("key").to_numpy().view(np.uint64), table.column("trained").to_numpy()
        known = trained > 0
        value = Trie(keys[known], trained[known], low.value).score(keys)
        return pa.table({"key": table.column("key"), "n": table.column("n"), "value": pa.array(value)})

    both = grams_of(asked).select("key", "n", F.lit(0).cast("long").alias("trained"))
    both = both.union(grams_of(counts).select("key", F.lit(0).cast("long"), "n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))
    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    shards = partitions(grams_of(asked).count(), SHARD_GRAMS)
    both = both.withColumn("shard", F.pmod(F.xxhash64(context), F.lit(shards)))
    return both.groupBy("shard").applyInArrow(lambda t: run(t.select(["key", "n", "trained"])), "key long, n long, value double")


def _frequent(values: DataFrame) -> F.Column:
    """Which grams of ``values`` are broadcast: all, or those above the least power of two that leaves ``MAX_GRAMS`` at most."""
    sizes = values.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()
    least = next(p for p in range(64) if sum(r.c for r in sizes if r.p >= p) <= MAX_GRAMS)
    return F.col("n") >= (1 << least)


def held_out(doc_id) -> F.Column:
    """Whether a row is kept out of training: CRC-32 of its id as text, modulo 10, is 0; so it is for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: tokens are words and one end; ``base_score``
    is the log10 probability under smoothed word frequencies of the training rows, ``score`` the one under PPM.
    A null text is an empty one and has only its end. A NUL byte in a text is the same symbol as the end and as what stands before a text. Repeated rows and null ids come back as they are; an empty table
    gives an empty result, and a table without training rows scores every byte as one of 256. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = stored(counted(docs.where(~F.col("held_out"))), "counts")
    asked = stored(counts.unionByName(counted(docs.where("held_out"))), "asked")
    values = stored(_values(asked, counts), "values")
    total, distinct = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = (F.col("kind") == WORD) & (F.col("n") * (1 << FREQUENT_BITS) > total)
    common = counts.where(frequent).select("key", "n").toArrow()
    word_n = np.append(common.column("n").to_numpy(), 0)
    often = _frequent(values)
    usual = values.where(often).select("key", "value").toArrow()
    model = spark.sparkContext.broadcast(
        (
            Lookup(common.column("key").to_numpy().view(np.uint64)), np.log10(word_n + 0.1),
            Lookup(usual.column("key").to_numpy().view(np.uint64)), np.append(usual.column("value").to_numpy(), 0.0),
        )
    )
    end_n = counts.where((F.col("kind") == WORD) & (F.col("key") == F.lit(np.uint64(END).view(np.int64).item()))).select("n").first()
    end_n = end_n[0] if end_n else 0

    def run(batches):
        lookup, logs, usual, value = model.value
        for batch in batches:
            rows = []
            for _, words in chunks(batch.column(3)):
                n = len(words)
                hashes = words.hashes()
                at = lookup.find(hashes)
                known = at >= 0
                owner = np.repeat(np.arange(n), np.diff(words.bounds))
                base = np.bincount(owner[known], logs[at[known]], minlength=n).astype(np.float64)  # counts stay integers without words
                keys, first = grams(words)
                gram = usual.find(keys)  # the last value is that of a gram to be joined
                ppm = np.add.reduceat(value[gram], first)
                gram_owner = np.repeat(np.arange(n), np.diff(np.append(first, len(keys))))[gram < 0]
                unusual_at = np.concatenate(([0], np.cumsum(np.bincount(gram_owner, minlength=n))))
                unusual = pa.ListArray.from_arrays(pa.array(unusual_at.astype(np.int32)), signed(keys[gram < 0]))
                rare_at = np.concatenate(([0], np.cumsum(np.bincount(owner[~known], minlength=n))))
                rare = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), signed(hashes[~known]))
                rows.append((np.diff(words.bounds), np.bincount(owner[known], minlength=n), base, ppm, rare, unusual))
            if rows:
                n_words, n_known, base, ppm = (np.concatenate(x) for x in list(zip(*rows, strict=True))[:4])
                rare, unusual = (pa.concat_arrays([r[c] for r in rows]) for c in (4, 5))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(n_words.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(ppm), rare, unusual],
                    names=["row", "doc_id", "held_out", "n_words", "n_known", "base", "score", "rare", "unusual"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_words long, n_known long, base double, score double, rare array<long>, unusual array<long>"
    part = stored(docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema), "scored")

    # words beyond the frequent ones: by a join
    rare = part.select("row", F.explode("rare").alias("key"))
    rare_counts = counts.where((F.col("kind") == WORD) & ~frequent).select("key", "n")
    sums = rare.join(rare_counts, "key", "left").groupBy("row")
    sums = sums.agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base"))
    # grams beyond the frequent ones: likewise
    gram_sums = part.select("row", F.explode("unusual").alias("key")).join(values.where(~often).select("key", "value"), "key")
    gram_sums = gram_sums.groupBy("row").agg(F.sum("value").alias("rare_score"))
    rest = F.lit(total + 0.1 * (distinct + 1))
    tokens = F.col("n_words") + 1
    return part.join(sums, "row", "left").join(gram_sums, "row", "left").select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(end_n > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.log10(F.lit(end_n + 0.1)) - tokens * F.log10(rest)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
