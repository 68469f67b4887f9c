"""Operator 1: SimHash near-duplicates, linked exactly through vantage-point shards.

Two 64-bit fingerprints within four bits of each other differ by at most one bit in at least one of
three blocks (22, 21 and 21 bits). Every block has a vantage-point tree on the Hamming distance within
that block: each level compares a fingerprint with one vantage point and sends it left (distance up to
the level's threshold) or right. By the triangle inequality two blocks at distance one lie on different
sides only if the left one is exactly at the threshold, so only such a fingerprint is also stored on
the right; all other branches are pruned. Each leaf is a shard in which pairs are compared exactly.
Depth follows the number of distinct fingerprints, so a leaf keeps about the same size as data grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import partitions, stored
from .textops import mix, signed

BLOCKS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
LEAF = 1024
SAMPLE = 4096
GROUP_ROWS = 60_000
TILE = 1 << 21  # pairs compared at a time


def fingerprint(text: bytes | None, width: int) -> int:
    """SimHash over the XXH64 (seed 42) of word shingles; an empty text gives zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        begins = np.concatenate(([0], stops[:-width])).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(begins, (stops[width - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a signed long) of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            texts = (t.as_py() for t in batch.column(batch.num_columns - 1))
            fps = np.fromiter((fingerprint(t, width) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    picked = docs.select(*keep, F.col("text").cast("binary").alias("_in_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)]), "fp long"])
    return picked.mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Vantage points and thresholds of one tree for each block ``(word, shift, width)``; a few hundred numbers in all.

    Blocks that differ by at most one bit share a cell. Depth follows ``count``, so that a cell keeps about ``leaf`` rows.
    """

    def __init__(self, count: int, sample: np.ndarray, blocks, leaf: int):
        rng = np.random.default_rng(20240229)
        self.trees = []
        for word, shift, width in blocks:
            edge = math.comb(width, width // 2) / 2**width  # about the share that lies on a threshold and is stored on both sides
            depth = min(40, max(0, math.ceil(math.log(max(1, count) / leaf) / math.log(2 / (1 + edge)))))
            mask = (1 << width) - 1
            points = rng.integers(0, mask + 1, size=depth, dtype=np.uint64)
            block = (sample[:, word] >> np.uint64(shift)) & np.uint64(mask)
            cuts = [int(np.median(distance(block, p))) if len(block) else width // 2 for p in points]
            self.trees.append((word, shift, mask, points, cuts))

    def block(self, tree: int, words: np.ndarray) -> np.ndarray:
        word, shift, mask, _, _ = self.trees[tree]
        return (words[:, word] >> np.uint64(shift)) & np.uint64(mask)

    def cells(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, tree and row of each cell that a row of ``words`` is in: its home leaf and the leaves beyond a boundary it touches."""
        keys, trees, rows = [], [], []
        for t, (*_, points, cuts) in enumerate(self.trees):
            block = self.block(t, words)
            code, owner = np.ones(len(words), dtype=np.int64), np.arange(len(words))
            for point, cut in zip(points, cuts, strict=True):
                far = distance(block, point)[owner]
                edge = far == cut
                code = np.concatenate((code * 2 + (far > cut), code[edge] * 2 + 1))
                owner = np.concatenate((owner, owner[edge]))
            keys.append(code * len(self.trees) + t)
            trees.append(np.full(len(code), t, dtype=np.int8))
            rows.append(owner)
        return np.concatenate(keys), np.concatenate(trees), np.concatenate(rows)


class Tiles:
    """Cells of too many rows, dealt over several tasks so that every two rows that have to be compared meet in one.

    A cell has ``a`` tiles of rows that needn't be compared with one another (such as those of one group already) and ``b`` tiles of others.
    """

    def __init__(self, cells: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.a, self.b = cells[order], a[order], b[order]

    def deal(self, keys: np.ndarray, salt: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pieces and the row of ``keys`` in each; ``first`` marks rows of the tiles ``a``."""
        if not len(self.cells) or not len(keys):
            return keys, np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.cells, keys), len(self.cells) - 1)
        hot = self.cells[at] == keys
        rows, at = np.flatnonzero(hot), at[hot]
        first = first[rows]
        n = np.where(first, self.b[at], self.a[at] + self.b[at])
        rep = np.repeat(np.arange(len(rows)), n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b, spread = self.a[at][rep], self.b[at][rep], salt[rows].astype(np.uint64)[rep]
        own = np.where(first[rep], spread % np.maximum(a, 1).astype(np.uint64), a.astype(np.uint64) + spread % np.maximum(b, 1).astype(np.uint64)).astype(np.int64)
        other = np.where(first[rep], a + other, other)
        pair = (np.minimum(own, other) << 31 | np.maximum(own, other)).astype(np.uint64)
        dealt = mix(mix(keys[rows][rep].astype(np.uint64)) + pair * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).astype(np.int64)
        return np.concatenate((keys[~hot], dealt)), np.concatenate((np.flatnonzero(~hot), rows[rep]))


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the smallest index in each one's group) after the links from ``i`` to ``j``."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper


def _linked(a: np.ndarray, bits: int) -> np.ndarray:
    """The smallest index that each of ``a`` reaches over links of ``bits`` or fewer; a large set is first cut by further vantage points.

    Links go into the groups tile by tile, so that memory holds those of ``TILE`` pairs at most.
    """
    label = np.arange(len(a))
    stack = [np.arange(len(a))]
    while stack:
        own = stack.pop()
        if len(own) > 2 * LEAF:
            far = distance(a[own], a[own[len(own) // 2]])
            cut = int(np.median(far))
            inner, outer = own[far <= cut], own[far > cut - bits]
            if max(len(inner), len(outer)) < 0.9 * len(own):
                stack += [inner, outer]
                continue
        x = a[own]
        rows = max(1, TILE // max(1, len(x)))
        for k in range(0, len(x), rows):
            i, j = np.nonzero(np.bitwise_count(x[k : k + rows, None] ^ x[None, k:]) <= bits)
            label = joined(label, own[i + k], own[j + k])
    return label


def _shard_edges(table: pa.Table, bits: int) -> pa.Table:
    """A spanning forest of the links in each cell of one shard: connectivity without all pairs of a group."""
    cell = table.column("cell").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    cuts = np.flatnonzero(np.diff(cell)) + 1
    us, vs = [], []
    for own in np.split(fp, cuts):
        own = np.unique(own)
        if len(own) > 1:
            roots = _linked(own, bits)
            moved = np.flatnonzero(roots != np.arange(len(own)))
            us.append(own[moved])
            vs.append(own[roots[moved]])
    u = np.concatenate(us) if us else np.zeros(0, np.uint64)
    v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def sampled_words(rows: DataFrame, columns: list[str], count: int) -> np.ndarray:
    """``columns`` of about ``SAMPLE`` rows (twice as many at most) as unsigned words, for thresholds."""
    every = max(1, count // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0).select(*columns).limit(2 * SAMPLE).toArrow()
    return np.column_stack([some.column(c).to_numpy().view(np.uint64) for c in columns])


def hot_cells(cells: DataFrame, limit: int) -> pa.Table:
    """``cell, count`` of the cells with more than ``limit`` rows; there are at most so many as ``limit`` goes into all rows."""
    return cells.groupBy("cell").count().where(F.col("count") > limit).toArrow()


def links(fps: DataFrame, bits: int = MAX_BITS, leaf: int = LEAF, limit: int = GROUP_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that join exactly the fingerprints reachable over links of ``bits`` or fewer differing bits.

    ``fps`` has one row for each distinct ``fp``. At most ``MAX_BITS`` bits; more would need other blocks. Cells have about ``leaf`` rows; one of more
    than ``limit``, as near fingerprints can make it, is dealt over several tasks.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be from 0 to {MAX_BITS}")
    count = fps.count()
    forest = Forest(count, sampled_words(fps, ["fp"], count), [(0, *b) for b in BLOCKS], leaf)

    def spread(tiles: Tiles):
        def run(batches):
            for batch in batches:
                fp = batch.column(0).to_numpy().view(np.uint64)
                keys, _, rows = forest.cells(fp[:, None])
                keys, at = tiles.deal(keys, mix(fp)[rows], np.zeros(len(keys), bool))
                yield pa.RecordBatch.from_arrays([pa.array(keys), signed(fp[rows[at]])], names=["cell", "fp"])

        return fps.select("fp").mapInArrow(run, "cell long, fp long")

    none = np.zeros(0, np.int64)
    hot = hot_cells(spread(Tiles(none, none, none)), limit)
    size = hot.column("count").to_numpy()
    cells = spread(Tiles(hot.column("cell").to_numpy(), np.zeros(len(size), np.int64), -(-2 * size // limit)))
    per_row = 1.25 * sum(1.168 ** len(points) for *_, points, _ in forest.trees)
    shards = partitions(int(per_row * count), limit)
    cells = cells.withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)))
    return cells.groupBy("shard").applyInArrow(lambda t: _shard_edges(t, bits), "u long, v long")


def _labels(marked: DataFrame, bits: int) -> DataFrame:
    """``fp, component_id`` for each different ``fp`` of ``marked(doc_id, fp)``."""
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fps")
    group = stored(components(links(fps, bits)), "fp_groups")
    all_fps = fps.join(group, fps.fp == group.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    first = all_fps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return all_fps.join(first, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: ``doc_id, fp, component_id``.

    Fingerprints of ``width``-word shingles link at ``bits`` or fewer differing bits; ``component_id`` is
    the smallest ``doc_id`` reachable, itself included. Null and empty texts have fingerprint zero and are
    linked like any other; a null ``doc_id`` takes part but names no component unless all are null; repeated
    rows are returned as often as they occur; an empty table gives an empty result; other columns are ignored.
    """
    marked = stored(fingerprints(docs, width), "fingerprints")
    return marked.join(_labels(marked, bits), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1."""
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
