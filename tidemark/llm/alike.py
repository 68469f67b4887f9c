"""Near-duplicates by the Jaccard similarity of word-shingle sets: SimHash in the vantage-point shards of operator 1, every link verified exactly.

Two sets of similarity 0.8 are 28 degrees apart, so SimHashes of 64 bits differ in about ten of them; linking at four bits finds few such pairs. Here a set has
three 64-bit SimHashes, cut into twelve blocks of 16 bits, each with a vantage-point tree. Two sets at 0.8 have a block that differs by at most one bit with a
probability of 0.98, more alike ones almost surely. Where they share such a block they meet in a cell, are candidates if at most ``MOST_BITS`` of all 192 bits differ (0.998
at 0.8), and link if the exact similarity of their sets is 0.8 or more. Equal sets are one from the start.

Groups are components of links. Each text first asks its nearest candidate and the one that has most candidates itself, the middle of a
large group. Texts that still have candidates of other groups are then compared exactly, but not all with all: in a fixed order of shingles, rare ones first, two sets that are 0.8 alike share
one among the first fifth of each, at places that leave enough to share (prefix and positional filter), so a large group of texts that are less alike costs no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import Forest, Tiles, distance, hot_cells, sampled_words
from .store import partitions, positional, restored, stored
from .textops import Words, chunks, mix, signed

WIDTH = 5
WORDS = ("w0", "w1", "w2")
WIDE = 16  # bits of a block
BLOCKS = [(word, shift, WIDE) for word in range(len(WORDS)) for shift in range(0, 64, WIDE)]
MOST_BITS = 44
LEAF = 50_000
LIMIT = 200_000
PAIRS = 64
TILE = 1 << 18  # pairs looked at at a time
TEXTS = 2000  # texts or pairs of texts that a Python task gets at a time
ROUNDS = 1
SAMPLE, MAX_OFTEN = 8_000, 200_000
NEAREST, MIDDLE, OPEN = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of all different shingles of ``width`` words, by text; a shorter text is one shingle, one without words has none."""
    h, n = words.hashes(), np.diff(words.bounds)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(words.bounds[:-1], n)
    last = np.minimum(n, width)[owner]
    begins = place + last <= n[owner]
    key = np.zeros(len(h), dtype=np.uint64)
    for k in range(width):
        far = np.flatnonzero(begins & (k < last))
        key[far] = mix((key[far] + h[far + k]) * _ODD)
    order = np.lexsort((key[begins], owner[begins]))
    key, owner = key[begins][order], owner[begins][order]
    new = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(owner, prepend=-1) != 0)
    return owner[new], key[new]


def _sets(texts: pa.Array, width: int):
    """Pieces of a batch: index of the first text, their number, where each one's set begins and the hashes in all sets."""
    for at, words in chunks(texts):
        owner, key = shingles(words, width)
        yield at, len(words), np.searchsorted(owner, np.arange(len(words) + 1)), key


def wide_fingerprints(ends: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The SimHashes of sets of hashes, one column a word: a bit is 1 if set in over half of a set's hashes."""
    n = len(ends) - 1
    owner, out = np.repeat(np.arange(n), np.diff(ends)), np.zeros((n, len(WORDS)), dtype=np.uint64)
    for word in range(len(WORDS)):
        ones = np.zeros((n, 64), dtype=np.int64)
        for k in range(0, len(key), 1 << 16):
            part, own = key[k : k + (1 << 16)], owner[k : k + (1 << 16)]
            bits = np.unpackbits(mix(part + np.uint64(word + 1) * _ODD).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.diff(own, prepend=-1) != 0)
            ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[:, word] = np.packbits(ones * 2 > np.diff(ends)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _marked(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``docs`` with ``mark``, which names a text's set of shingles, their number ``n`` and the words of its fingerprint."""
    columns = docs.columns
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            for at, n, ends, key in _sets(batch.column(place), width):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(key))))
                mark = mix((total[ends[1:]] - total[ends[:-1]]) ^ mix(np.diff(ends).astype(np.uint64)))
                words = wide_fingerprints(ends, key)
                more = [signed(mark), pa.array(np.diff(ends)), *(signed(np.ascontiguousarray(words[:, k])) for k in range(len(WORDS)))]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *more], names=[*columns, "mark", "n", *WORDS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "mark long, n long", *(f"{w} long" for w in WORDS)])
    return docs.mapInArrow(run, schema)


def _meetings(block: np.ndarray, words: np.ndarray, root: np.ndarray, n: np.ndarray):
    """Index pairs ``(i, j)``, both ways, and the differing bits of the candidates in a cell, ``TILE`` pairs or a row's at a time.

    Candidates' blocks differ by at most one bit and their fingerprints by ``MOST_BITS``; neither set is too small for the other, and they are of different groups.
    Rows in order of block lie in runs of equal ones; a row's partners are the runs of its own block and of those one bit away.
    """
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.diff(block, prepend=~block[:1]) != 0)
    values, run = block[first], np.diff(np.append(first, len(block)))
    own = np.repeat(np.arange(len(first)), run)
    for bit in range(-1, WIDE):
        other = values ^ np.uint64(1 << bit if bit >= 0 else 0)
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        m = np.where(values[at] == other, run[at], 0)[own]
        start, done, a = first[at][own], np.concatenate(([0], np.cumsum(m))), 0
        while a < len(block):
            z = max(a + 1, int(np.searchsorted(done, done[a] + TILE, side="right")) - 1)
            i = np.repeat(np.arange(a, z), m[a:z])
            j = np.repeat(start[a:z] - done[a:z], m[a:z]) + np.arange(done[a], done[z])
            a = z
            i, j = order[i], order[j]
            fits = root[i] != root[j]
            i, j = i[fits], j[fits]
            fits = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            bits = sum((distance(words[i, k], words[j, k]) for k in range(1, words.shape[1])), distance(words[i, 0], words[j, 0]))
            near = bits <= MOST_BITS
            if near.any():
                yield i[near], j[near], bits[near]


def _asked(mark, block, words, root, n, turn: int | None):
    """``(u, v, kind, cost)`` of a cell: of each row the nearest candidate and the one that has most candidates itself, or if ``turn`` is None, the rows that have any.

    In turns after the first only a quarter of the rows can be chosen, another one each time, so that new ones are.
    """
    rank = np.empty(len(mark), dtype=np.int64)
    rank[np.argsort(mix(mark), kind="stable")] = np.arange(len(mark))
    by_rank, size = np.argsort(rank), len(mark)
    nothing = np.iinfo(np.int64).max
    nearest, met = np.full(size, nothing), np.zeros(size, dtype=np.int64)
    open_to = (mix(mark + np.uint64(1)) & np.uint64(3)) == np.uint64(turn & 3) if turn else np.ones(size, dtype=bool)
    for i, j, bits in _meetings(block, words, root, n):
        met += np.bincount(i, minlength=size)
        i, j, bits = i[open_to[j]], j[open_to[j]], bits[open_to[j]]
        np.minimum.at(nearest, i, bits * size + rank[j])
    i = np.flatnonzero(nearest < nothing)
    if turn is None:
        yield mark[i], mark[i], np.full(len(i), OPEN, np.int8), np.zeros(len(i), np.int64)
        return
    yield mark[i], mark[by_rank[nearest[i] % size]], np.full(len(i), NEAREST, np.int8), nearest[i] // size
    if met.max(initial=0) > 1:
        least = rank - met * size  # the row with most candidates first
        middle = least.copy()
        for i, j, _ in _meetings(block, words, root, n):
            np.minimum.at(middle, i[open_to[j]], least[j[open_to[j]]])
        i = np.flatnonzero(middle < least)
        yield mark[i], mark[by_rank[middle[i] % size]], np.full(len(i), MIDDLE, np.int8), middle[i] // size


def _candidates(prints: DataFrame, forest: Forest, count: int, turn: int | None, limit: int) -> DataFrame:
    """``u, v`` of chosen candidates among ``prints(mark, root, n, w0, w1, w2)`` whose roots differ, chosen as ``_asked`` does in ``turn``; if that is None, ``mark`` of all rows that have such a candidate."""
    def spread(tiles: Tiles, major: dict, only_keys: bool = False):
        def run(batches):
            for batch in batches:
                words = np.column_stack([batch.column(k).to_numpy().view(np.uint64) for k in (3, 4, 5)])
                keys, trees, rows = forest.cells(words)
                mark, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if only_keys:
                    own = np.isin(keys, tiles.cells) if len(tiles.cells) else np.ones(len(keys), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(root[rows[own]])], names=["cell", "root"])
                    continue
                first = np.array([major.get(c) == r for c, r in zip(keys.tolist(), root[rows].tolist(), strict=True)], dtype=bool) if major else np.full(len(keys), turn is not None)
                keys, at = tiles.deal(keys, mix(mark.view(np.uint64))[rows], first)
                at, tree = pa.array(rows[at]), pa.array(trees[at])
                yield pa.RecordBatch.from_arrays([pa.array(keys), tree, *(batch.column(k).take(at) for k in range(6))], names=["cell", "tree", "mark", "root", "n", *WORDS])

        kinds = "cell long, root long" if only_keys else "cell long, tree byte, mark long, root long, n long, " + ", ".join(f"{w} long" for w in WORDS)
        return prints.select("mark", "root", "n", *WORDS).mapInArrow(run, kinds)

    none = np.zeros(0, np.int64)
    hot = hot_cells(spread(Tiles(none, none, none), {}, True), limit)
    cells, size, major = hot.column("cell").to_numpy(), hot.column("count").to_numpy(), {}
    pieces = lambda x: -(-2 * x // limit)
    tiles = Tiles(cells, pieces(size), np.ones(len(size), np.int64))  # the first round asks within one piece of a large cell
    if turn is None and len(cells):
        # rows of a large cell's largest group needn't meet one another
        own = spread(Tiles(cells, size, size), {}, True).groupBy("cell", "root").count()
        most = own.groupBy("cell").agg(F.max_by("root", "count").alias("root"), F.max("count").alias("most")).toArrow().to_pydict()
        major, largest = dict(zip(most["cell"], most["root"], strict=True)), dict(zip(most["cell"], most["most"], strict=True))
        inside = np.array([largest[c] for c in cells.tolist()], dtype=np.int64)
        tiles = Tiles(cells, pieces(inside), np.maximum(1, pieces(size - inside)))
    shards = partitions(2 * len(BLOCKS) * count, LIMIT)
    dealt = spread(tiles, major).withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)))

    def meet(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        order = np.lexsort((table.column("mark").to_numpy(), cell))
        cell, tree = cell[order], table.column("tree").to_numpy()[order]
        mark, root, n = (table.column(c).to_numpy()[order] for c in ("mark", "root", "n"))
        words = np.column_stack([table.column(w).to_numpy().view(np.uint64)[order] for w in WORDS])
        cuts, out = np.flatnonzero(np.diff(cell)) + 1, []
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            own = slice(a, b)
            if b - a > 1:
                block = forest.block(int(tree[a]), words[own])
                out += _asked(mark[own].view(np.uint64), block, words[own], root[own], n[own], turn)
        u, v, kind, bits = (np.concatenate([o[k] for o in out] or [np.zeros(0, t)]) for k, t in enumerate((np.uint64, np.uint64, np.int8, np.int64)))
        return pa.table({"u": signed(u), "v": signed(v), "kind": pa.array(kind.astype(np.int8)), "bits": pa.array(bits)})

    met = dealt.groupBy("shard").applyInArrow(lambda t: meet(t), "u long, v long, kind byte, bits long")
    if turn is None:
        return stored(met.select(F.col("u").alias("mark")).distinct(), "open")
    met = met.groupBy("u", "kind").agg(F.min_by("v", F.struct("bits", F.xxhash64("v"), "v")).alias("v"))
    return stored(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")


def _alike(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs ``(u, v)`` whose texts' sets have a similarity of 0.8 or more."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                own = batch.slice(k, PAIRS)
                owner, key, n = [], [], np.zeros(own.num_rows, dtype=np.int64)
                for c in (2, 3):
                    for at, m, ends, keys in _sets(own.column(c), width):
                        owner.append(at + np.repeat(np.arange(m), np.diff(ends)))
                        key.append(keys)
                        n[at : at + m] += np.diff(ends)
                owner, key = np.concatenate(owner), np.concatenate(key)
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (key[1:] == key[:-1])], minlength=own.num_rows)
                yield own.select(["u", "v"]).filter(pa.array(5 * both >= 4 * (n - both)))

    side = lambda x: texts.select(F.col("mark").alias(x), F.col("text").alias(f"t_{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "t_u", "t_v").mapInArrow(run, "u long, v long")


def _with_sets(texts: DataFrame, width: int) -> DataFrame:
    """``mark, shingles`` of ``texts(mark, text)``."""

    def run(batches):
        for batch in batches:
            for at, n, ends, key in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(key))], names=["mark", "shingles"])

    return texts.select("mark", "text").mapInArrow(run, "mark long, shingles array<long>")


def _prefix_pairs(texts: DataFrame, width: int) -> DataFrame:
    """``u, v``: candidates among ``texts(mark, text, root, w0, w1, w2)`` of different roots that share a shingle so early in the order of shingles that they can be 0.8 alike.

    The order puts shingles that are often in a sample of the texts last, the others by hash; any fixed order gives all such pairs.
    """
    every = max(1, texts.count() // SAMPLE)
    some = _with_sets(texts.where(F.pmod(F.xxhash64("mark"), F.lit(every)) == 0), width).select(F.explode("shingles").alias("token"))
    often = some.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(MAX_OFTEN).orderBy("token").toArrow()
    shared = texts.sparkSession.sparkContext.broadcast((often.column("token").to_numpy(), often.column("count").to_numpy()))

    def run(batches):
        tokens, counts = shared.value
        for batch in batches:
            for begin, _, ends, key in _sets(batch.column(1), width):
                n, token = np.diff(ends), key.view(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(tokens, token), max(0, len(tokens) - 1))
                count = np.where(tokens[at] == token, counts[at], 0) if len(tokens) else np.zeros(len(token), np.int64)
                order = np.lexsort((token, count, owner))
                place = np.arange(len(token)) - np.repeat(ends[:-1], n)
                early = np.flatnonzero(place < (n - (4 * n + 4) // 5 + 1)[owner])
                marks = batch.column(0).take(pa.array(owner[early] + begin))
                cols = [pa.array(token[order[early]]), marks, pa.array(n[owner[early]].astype(np.int32)), pa.array(place[early].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "mark", "n", "place"])

    found = texts.select("mark", "text").mapInArrow(run, "token long, mark long, n int, place int")
    found = stored(found.join(texts.select("mark", "root", *WORDS), "mark"), "prefixes", TEXTS)
    side = lambda x: found.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("mark", "n", "place", "root", *WORDS)))
    left = F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    fits = "mark_u < mark_v AND root_u <> root_v AND 5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)"
    bits = sum((F.bit_count(F.col(f"{w}_u").bitwiseXOR(F.col(f"{w}_v"))) for w in WORDS), F.lit(0))
    pairs = side("u").join(side("v"), "token").where(F.expr(fits) & (9 * left >= 4 * (F.col("n_u") + F.col("n_v"))) & (bits <= MOST_BITS))
    return stored(pairs.select(F.col("mark_u").alias("u"), F.col("mark_v").alias("v")).distinct(), "candidates")


def groups(prints: DataFrame, text_of, width: int, leaf: int = LEAF, limit: int = LIMIT) -> DataFrame:
    """``(node, root)`` of the marks that links of 0.8 or more join, ones without a link left out; ``prints(mark, n, w0, w1, w2)`` has a row for each mark.

    ``text_of``, a function of a table of marks, gives their texts ``(mark, text)``.
    """
    count = prints.count()
    prints = prints.where("n >= 4")  # sets of fewer are 0.8 alike only if they are equal
    forest = Forest(count, sampled_words(prints, list(WORDS), count), BLOCKS, leaf)
    rooted, links = prints.withColumn("root", F.col("mark")), None
    for turn in range(ROUNDS):
        pairs = _candidates(rooted, forest, count, turn, limit)
        marks = pairs.select(F.col("u").alias("mark")).union(pairs.select("v")).distinct()
        found = stored(_alike(pairs, stored(text_of(marks), "texts"), width), "alike", TEXTS)
        links = found if links is None else links.union(found)
        known = stored(components(links), "groups")
        rooted = prints.join(known, prints.mark == known.node, "left").select("mark", F.coalesce("root", "mark").alias("root"), "n", *WORDS)

    open_ = _candidates(rooted, forest, count, None, limit)
    texts = stored(text_of(open_).join(rooted.select("mark", "root", *WORDS), "mark"), "open_texts")
    more = stored(_alike(_prefix_pairs(texts, width), texts, width), "alike", TEXTS)
    return stored(components(links.union(more)), "groups")


def without_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with one row left of each group of near-duplicates, the one with the smallest ``doc_id``.

    Two texts link if the sets of their shingles of ``width`` words have a Jaccard similarity of 0.8 or more; groups are the components. Texts without words
    are alike. Of repeated rows one stays; ids sort before a null one; all columns are returned. An empty table gives an empty result.
    """
    own, names = positional(docs)
    doc_id, text = names["doc_id"], names["text"]
    marked = stored(_marked(own, text, width).withColumn("row", F.monotonically_increasing_id()), "marked", TEXTS)
    prints = marked.groupBy("mark").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", *WORDS)))
    prints = stored(prints, "prints")

    def text_of(marks: DataFrame) -> DataFrame:
        rows = prints.join(marks, "mark", "left_semi").select("mark", "row")
        return marked.select("row", F.col(text).cast("binary").alias("text")).join(rows, "row").select("mark", "text")

    known = groups(prints.drop("row"), text_of, width)
    first = marked.groupBy("mark").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), "row")).alias("s"))
    first = first.join(known, first.mark == known.node, "left").groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("s").alias("s"))
    return restored(marked.join(first.select("s.row"), "row", "left_semi"), names)
