"""Operator 8: benchmark decontamination by spaced seeds.

A seed is a run of ``SPAN`` words or fewer of which a fixed mask looks at six and ignores the others, so a replaced word spoils
only the seeds that look at it. The masks are complete: any ten words in a row with two replaced, any nine with one, and any 15 to 19 with three
have a seed that looks at none of the replaced ones; longer runs with a fifth replaced hold ten words with two at most. Test and training texts meet on equal seed hashes; each meeting proposes an alignment, whose words are
then compared one by one, replaced words tolerated. Words are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased.

Items of fewer than ``SPAN`` words have seeds of their own: of all words below five, else of all but one, since only one of five to nine words may differ.

The training side first asks a bit table of the test seeds (two bits a seed, ``2**MAX_BITS`` bits at most, however large the
benchmark is) and keeps only stretches of text around seeds that may occur; the exact join follows on those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textops import NO_WORD, Words, chunks, mix, signed

# The positions each mask looks at.
MASKS = [(0, 1, 2, 3, 4, 5), (0, 1, 2, 5, 6, 7), (0, 1, 3, 5, 8, 9), (0, 1, 3, 4, 6, 7), (0, 1, 2, 6, 8, 9)]
SPAN = 10
MIN_BITS, MAX_BITS = 20, 26
RADIUS = 40
MIN_WORDS = 13
AGREE = 0.8


Mask = tuple[int, tuple[int, ...], int | None]  # number, positions, words of the items that it is for (None: ``SPAN`` or more)


def masks(short: list[int]) -> list[Mask]:
    """The fixed masks and those for items of ``short`` words (below ``SPAN``); leaving out either end is the same mask."""
    out: list[Mask] = [(m, mask, None) for m, mask in enumerate(MASKS)]
    for n in short:
        left_out = [n] if n < 5 else range(1, n)
        out += [(10 * n + k % n, tuple(j for j in range(n) if j < n - (k == n - 1) and j != k), n) for k in left_out]
    return out


def seeds(words: Words, masks: list[Mask], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place (index among all words) of every seed that lies within one text; of ``whole`` texts, masks look only at those that they are for."""
    h, n = words.hashes(), np.diff(words.bounds)
    owner = np.repeat(np.arange(len(words)), n)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for number, mask, length in masks:
        span = mask[-1] + 1
        if len(h) < span:
            continue
        at = np.flatnonzero(owner[: len(h) - span + 1] == owner[span - 1 :])
        if whole:
            at = at[n[owner[at]] >= SPAN if length is None else n[owner[at]] == length]
        total = np.full(len(at), number + 1, dtype=np.uint64)
        for k in mask:
            total = (total + h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mix(total), owner[at], at))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _test_seeds(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(test, words)`` with hashes of the words of each different text, and its seeds ``(hash, test, test_at)``."""
    every = masks(list(range(1, SPAN)))

    def run(batches):
        for batch in batches:
            for i, words in chunks(batch.column(1), NO_WORD):
                own = batch.slice(i, len(words)).column(0)
                h, text, at = seeds(words, every, True)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(words) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (signed(h[order]), pa.array((at - words.bounds[text])[order].astype(np.int32)))]
                hashes = pa.ListArray.from_arrays(pa.array(words.bounds.astype(np.int32)), pa.array(words.hashes().astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([own, hashes, *lists], names=["test", "test_words", "hash", "at"])

    found = stored(tests.mapInArrow(run, "test long, test_words array<int>, hash array<long>, at array<int>"), "tests")
    each = found.select("test", F.explode(F.arrays_zip("hash", "at")).alias("s"))
    return found.select("test", "test_words"), each.select(F.col("s.hash").alias("hash"), "test", F.col("s.at").alias("test_at"))


def _stretches(table: np.ndarray, looked_at: list[Mask]):
    """A function of batches ``(..., text)`` that appends the stretches of text whose seeds are in the bit table."""

    size = int(len(table) * 8).bit_length() - 1

    def bits(spots):
        return (table[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1

    def of(words: Words) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(words))]
        h, text, at = seeds(words, looked_at)
        first, second = _spots(h, size)
        maybe = np.flatnonzero(bits(first))
        maybe = maybe[bits(second[maybe])]
        if not len(maybe):
            return out
        maybe = maybe[np.argsort(at[maybe], kind="stable")]
        h, text, at = h[maybe], text[maybe], at[maybe]
        narrow = words.hashes().astype(np.uint32).view(np.int32)
        cuts = np.flatnonzero((np.diff(at) > RADIUS) | (np.diff(text) > 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            low, high = words.bounds[text[a]], words.bounds[text[a] + 1]
            left = max(low, at[a] - RADIUS)
            own = narrow[left : min(high, at[b - 1] + SPAN + RADIUS)]
            hits = [{"hash": x, "at": y} for x, y in zip(h[a:b].view(np.int64).tolist(), (at[a:b] - left).tolist(), strict=True)]
            out[text[a]].append({"begin": int(left - low), "words": own.tolist(), "hits": hits})
        return out

    return of


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """The run (begin, end, equal words) of most equal words that begins and ends with one and has ``AGREE`` of them equal; the first of such."""
    value = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - AGREE, -AGREE))))
    count = np.concatenate(([0], np.cumsum(equal)))
    # a run agrees well enough if its value is no less at the end than at the beginning; the earliest such beginning of each end
    begin = np.minimum(np.searchsorted(-np.minimum.accumulate(value), -value - 1e-9), np.arange(len(value)))
    end = int(np.argmax(count - count[begin]))
    same = begin[end] + np.flatnonzero(equal[begin[end] : end])
    return (int(same[0]), int(same[-1]) + 1, len(same)) if len(same) else (0, 0, 0)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` with the benchmark passages it holds.

    ``doc_id, text_hash, leaked, item_ids, n_equal, spans``: ``leaked`` if some alignment with an item of ``benchmark(item_id, text, ...)`` has
    a run with ``AGREE`` of its words equal that holds ``MIN_WORDS`` equal ones, or that share of a shorter item's words. ``item_ids`` are the sorted ids of
    such items, ``n_equal`` the most equal words, ``spans`` the runs in the document (words from 0). ``text_hash`` is Spark's xxhash64 of the text.
    Null texts are empty and hold nothing; an item without words is never found; null ids come back as they
    are (a null ``item_id`` leaves ``item_ids`` without it); equal items are found once, with all ids; repeated rows stay repeated; empty tables
    give an empty result or no leaks; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    items = stored(items.withColumn("test", F.monotonically_increasing_id()), "items")
    test_words, test_seeds = _test_seeds(items.select("test", F.col("text").cast("binary").alias("text")))
    test_seeds = stored(test_seeds, "test_seeds")
    short = test_words.where(F.size("test_words").between(1, SPAN - 1)).select(F.size("test_words")).distinct().collect()
    looked_at = masks(sorted(r[0] for r in short))
    bits = min(MAX_BITS, max(MIN_BITS, int(512 * test_seeds.count()).bit_length()))
    spots = test_seeds.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))).alias("spot"))
    spots = spots.distinct().toArrow().column(0).to_numpy()  # 2**MAX_BITS at most
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    np.bitwise_or.at(table, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stretch = "array<struct<begin:int,words:array<int>,hits:array<struct<hash:long,at:int>>>>"
    arrow = pa.list_(pa.struct({"begin": pa.int32(), "words": pa.list_(pa.int32()), "hits": pa.list_(pa.struct({"hash": pa.int64(), "at": pa.int32()}))}))

    def run(batches):
        of = _stretches(shared.value, looked_at)
        for batch in batches:
            got = [x for _, words in chunks(batch.column(3), NO_WORD) for x in of(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, type=arrow)], names=["row", "doc_id", "text_hash", "found"])

    scanned = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    scanned = stored(scanned.mapInArrow(run, f"row long, doc_id {kind}, text_hash long, found {stretch}"), "stretches")
    parts = scanned.select("row", F.posexplode("found").alias("part", "s")).select("row", "part", "s.*")
    hits = parts.select("row", "part", F.explode("hits").alias("h")).select("row", "part", F.col("h.hash").alias("hash"), F.col("h.at").alias("at"))
    lines = hits.join(test_seeds, "hash").select("row", "part", "test", (F.col("at") - F.col("test_at")).alias("shift")).distinct()
    lines = lines.join(parts.select("row", "part", "begin", "words"), ["row", "part"]).join(test_words, "test")

    def verify(batches):
        for batch in batches:
            keep, n_equal, begins, ends = [], [], [], []
            rows = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            for k, (shift, begin, own, test) in enumerate(rows):
                a, b = max(0, -shift), min(len(test), len(own) - shift)
                equal = np.array(own[a + shift : b + shift]) == np.array(test[a:b])
                start, end, n = best_run(equal)
                if n >= min(MIN_WORDS, int(np.ceil(AGREE * len(test)))):
                    keep.append(k)
                    n_equal.append(n)
                    begins.append(begin + a + shift + start)
                    ends.append(begin + a + shift + end)
            chosen = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(n_equal, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                names=["row", "test", "n_equal", "begin", "end"],
            )

    runs = lines.select("row", "test", "shift", "begin", "words", "test_words").mapInArrow(verify, "row long, test long, n_equal int, begin int, end int")
    told = runs.join(items.select("test", "item_ids"), "test").groupBy("row")
    told = told.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.max("n_equal").alias("n_equal"),
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"),
    )
    return scanned.select("row", "doc_id", "text_hash").join(told, "row", "left").select(
        "doc_id",
        "text_hash",
        F.col("n_equal").isNotNull().alias("leaked"),
        F.coalesce("item_ids", F.array().cast(told.schema["item_ids"].dataType)).alias("item_ids"),
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce("spans", F.array().cast(told.schema["spans"].dataType)).alias("spans"),
    )
