"""Operator 3: resharding by a minimum-cost flow of blocks between shards.

From the sizes of the old shards and the new capacities a small transport problem says how many bytes each
overfull shard sends to each one with room, at the least bytes moved. Its flow is then filled with blocks:
rows of one old shard, grouped by hash into as many as its bytes are ``BLOCKS``ths of a new shard, and every large
document alone. The number of blocks depends on the numbers of shards and not on that of the rows. At last the files of the shards that lose or gain
rows are written anew; those of the others stay as they are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

BLOCKS = 128
CHUNK_ROWS = 50_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flow ``{(i, j): amount}`` that meets as much as possible at the least total cost (successive shortest paths)."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    ends: list[list[int]] = [[] for _ in range(n + m + 2)]
    edges: list[list[int]] = []  # head, room, cost; the reverse of edge k is edge k ^ 1

    def add(a: int, b: int, room: int, price: int) -> None:
        ends[a].append(len(edges))
        ends[b].append(len(edges) + 1)
        edges.extend(([b, room, price], [a, 0, -price]))

    for i, x in enumerate(supply):
        add(source, i, x, 0)
    for j, x in enumerate(demand):
        add(n + j, sink, x, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supply[i], demand[j]), cost[i][j])
    height = [0] * (n + m + 2)
    while True:
        far, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in ends[a]:
                b, room, price = edges[k]
                if room > 0 and (e := d + price + height[a] - height[b]) < far.get(b, e + 1):
                    far[b], by[b] = e, k
                    heapq.heappush(heap, (e, b))
        if sink not in far:
            break
        most = max(far.values())
        height = [h + far.get(a, most) for a, h in enumerate(height)]
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = edges[by[a] ^ 1][0]
        amount = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= amount
            edges[k ^ 1][1] += amount
    pairs = [(i, j) for i in range(n) for j in range(m)]
    return {p: x for p, k in zip(pairs, range(first, len(edges), 2), strict=True) if (x := edges[k + 1][1]) > 0}


def place_blocks(blocks: list[tuple[int, int, int]], capacities: list[int]) -> list[int]:
    """The new shard of each block ``(old shard, block, bytes)``; old shards beyond the new ones are given up.

    A shard keeps what fits, large blocks first; the flow decides where the rest goes. Blocks are then put on the
    target with the most of that flow left. At last blocks step from the fullest shard to the emptiest one
    while that brings the two nearer, those that have moved anyway first.
    """
    n = len(capacities)
    target: list[int] = [-1] * len(blocks)
    load, away = [0] * n, defaultdict(list)
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][2], blocks[k])):
        old, _, size = blocks[k]
        if old < n and load[old] + size <= capacities[old]:
            target[k], load[old] = old, load[old] + size
        else:
            away[old].append(k)
    senders = sorted(away)
    room = [max(0, c - x) for c, x in zip(capacities, load, strict=True)]
    flow = min_cost_flow([sum(blocks[k][2] for k in away[i]) for i in senders], room, [[int(i != j) for j in range(n)] for i in senders])
    for at, i in enumerate(senders):
        left = {j: x for (a, j), x in flow.items() if a == at} or dict(enumerate(room))
        for k in away[i]:
            j = max(left, key=lambda j: (left[j], -j))
            target[k], left[j], load[j] = j, left[j] - blocks[k][2], load[j] + blocks[k][2]
    owned: list[list[int]] = [[] for _ in range(n)]
    for k, j in enumerate(target):
        owned[j].append(k)
    for _ in range(4 * len(blocks)):
        over = [load[j] - capacities[j] for j in range(n)]
        full, empty = over.index(max(over)), over.index(min(over))
        gap = over[full] - over[empty]
        fits = [k for k in owned[full] if 0 < blocks[k][2] < gap]
        if not fits:
            break
        k = min(fits, key=lambda k: (abs(gap - 2 * blocks[k][2]), target[k] == blocks[k][0], k))
        if max(abs(over[full] - blocks[k][2]), abs(over[empty] + blocks[k][2])) >= max(abs(over[full]), abs(over[empty])):
            break
        owned[full].remove(k)
        owned[empty].append(k)
        target[k] = empty
        load[full] -= blocks[k][2]
        load[empty] += blocks[k][2]
    return target


def sized(docs: DataFrame, old_shard) -> DataFrame:
    """Size (UTF-8 bytes of the text plus 16), checksum and old shard of every row; a null text has no bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumns({"size": size, "text_crc32": crc, "old_shard": F.coalesce(old_shard.cast("int"), F.lit(0))})


def _assigned(rows: DataFrame, shards: int, weights: list[float] | None) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``shard, _row, _chunk``, stored once with their blocks, and the shards that lose or gain rows."""
    rows = rows.drop("shard", "slot").withColumns({"size": F.coalesce("size", F.lit(0)).cast("long"), "old_shard": F.coalesce("old_shard", F.lit(0)).cast("int")})
    olds = {r.old_shard: (r.n, r.bytes) for r in rows.groupBy("old_shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    number, total = (sum(x[k] for x in olds.values()) for k in range(2))
    large = max(1, total // (shards * BLOCKS))
    chunks = max(1, number // CHUNK_ROWS)
    blocks = rows.sparkSession.createDataFrame([(o, max(1, -(-size // large))) for o, (_, size) in olds.items()], "old_shard int, _blocks long")
    alone = F.when(F.col("size") >= large, F.col("_row")).otherwise(-1)
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(blocks), "old_shard")
    block = F.when(alone >= 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    rows = stored(rows.withColumns({"_alone": alone, "_block": block, "_chunk": F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(chunks)).cast("int")}).drop("_blocks"), "blocks")

    # at most shards * BLOCKS large rows, and as many blocks and one more for each old shard
    key = ["old_shard", "_block", "_alone"]
    table = rows.groupBy(*key).agg(F.sum("size").alias("bytes")).orderBy(*key).collect()
    weights = weights or [1.0] * shards
    target = place_blocks([(r.old_shard, k, r.bytes) for k, r in enumerate(table)], [int(total * w / sum(weights)) for w in weights])
    moves = rows.sparkSession.createDataFrame([(r.old_shard, r._block, r._alone, j) for r, j in zip(table, target, strict=True)], "old_shard int, _block int, _alone long, shard int")
    touched = {i for r, j in zip(table, target, strict=True) if j != r.old_shard for i in (j, r.old_shard)}
    return rows.join(F.broadcast(moves), key).drop("_alone", "_block"), sorted(touched)


def _slotted(rows: DataFrame) -> DataFrame:
    """A row's slot: rows of the shard's chunks before its own, then its place in the chunk."""
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_row")))
    rows = rows.join(counts, ["shard", "_chunk"]).withColumn("slot", F.col("_before") + F.col("_at") - 1)
    return rows.drop("_row", "_chunk", "_before", "_at")


def reshard(rows: DataFrame, shards: int, weights: list[float] | None = None) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard) to ``rows(size, old_shard, ...)``.

    Capacities are in proportion to ``weights``, equal by default. Shards come as near to them as blocks allow: within a
    hundredth or so, or the largest document. Null sizes count as 0, null old shards as shard 0. The rows are
    stored once with their blocks, so that each pass meets them alike. Repeated rows are rows of their own; an empty table gives an empty result.
    """
    return _slotted(_assigned(rows, shards, weights)[0])


def rewritten(rows: DataFrame, shards: int, path: str, weights: list[float] | None = None, keep: tuple[str, ...] = ("doc_id", "size", "text_crc32")) -> DataFrame:
    """Reshard ``rows`` and write whole the shards that lose or gain rows under ``path``, a folder each; ``keep``, ``old_shard, shard, slot`` of all rows.

    What it returns of those shards is read from the files written. A shard whose rows all stay and which receives none keeps its files and is
    not written. Rows go from the stored blocks to the files of their shards without a shuffle; only ``keep`` is sorted for the slots. As for
    ``reshard`` otherwise.
    """
    placed, touched = _assigned(rows, shards, weights)
    new, hidden = F.col("shard").isin(touched), ("_row", "_chunk")
    own = placed.where(new)
    own.write.mode("overwrite").partitionBy("shard").parquet(path)
    columns = [*keep, "old_shard", "shard", *hidden]
    found = rows.sparkSession.read.schema(own.schema).parquet(path).select(*columns).unionByName(placed.where(~new).select(*columns))
    return _slotted(found)


def by_source(docs: DataFrame) -> DataFrame:
    """The old layout of ``documents``: each source in one of 40 shards, by its checksum."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")
    return sized(docs, F.pmod(F.crc32(source), F.lit(40)))
