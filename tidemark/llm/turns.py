"""Operator 12: the prefix trie of conversations, by merging partial tries.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it. A node's key is the
exclusive or of two 64-bit hashes of each of its turns with their place, so a prefix's key is a running aggregate and its parent's key is one
step away; keys of 128 bits stand for the sequences.

Partitions emit locally combined node tables, which are merged in a tree: tables of ``FAN`` partitions into one, until one is left, so a
node of nearly all conversations is combined bit by bit. Lists of the conversations that end in a node are kept as sorted blocks of ids. The
roll-up from the bottom works on nodes of two members or more (others are chains with one leaf that save nothing) and doubles its reach
with each round: a node adds the sums of those just as far below as it has summed, so a chain of any depth takes its logarithm in rounds.

A conversation of any length is split: turns are dealt by ranges of their order, numbered and hashed by piece, and pieces are shifted by what
stands before them.

Edge cases, all defined: a null role or text is empty; rows with a null conversation are left out; null turns come first; turns with the same
number are ordered by role and the MD5 of their role and text, repeated rows are turns of their own; conversations without turns left end in
the root; an empty table gives an empty trie, without a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

FAN = 16  # partial tries that a merge takes together
BLOCK = 512  # conversations in a block of an end list, by id
KEY, PARENT = ("k1", "k2"), ("p1", "p2")


def _lane(lane: int, place: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(lane), place.cast("long"), turn)


def placed(turns: DataFrame) -> DataFrame:
    """``conv_id, part, pos, turn_hash, size`` of every turn: its place in its conversation, the MD5 of role and text, the text's code points.

    ``part`` is a range of the order of conversation and turn, so a long conversation has several and each is numbered for itself.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))).alias("turn_hash"), F.length(text).alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), "role", "turn_hash", "row"]
    laid = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    own = Window.partitionBy("part", "conv_id")
    pieces = laid.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = laid.withColumn("place", F.row_number().over(own.orderBy(*order)) - 1)
    return stored(numbered.join(pieces, ["part", "conv_id"]).select("conv_id", "part", (F.col("earlier") + F.col("place")).alias("pos"), "turn_hash", "size"), "placed")


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """Rows ``conv_id, part, depth, k1, k2, p1, p2, size, ends`` of all prefixes of conversations whose first ``head`` turns are those of ``base``.

    ``head`` (at most ``most``) and ``base`` are columns of ``conv_id``; ``turns`` comes from ``placed``. Conversations without turns have a
    row too, that of the root, as all have.
    """
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "size"))).alias("first"))
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    convs = counts.groupBy("conv_id").agg(F.sum("n").alias("n_own"), F.min("part").alias("part")).withColumns({"h": head, "base": base})
    convs = convs.join(heads, "base", "left").withColumn("first", F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["first"].dataType)))
    convs = convs.withColumns({"n_head": F.size("first"), "n": F.size("first") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))})
    convs = stored(convs.select("conv_id", "part", "h", "first", "n_head", "n"), "heads")

    def upto(lane: int, n: Column) -> Column:
        """The key's half of a head's first ``n`` turns."""
        hashes = F.transform(F.slice("first", F.lit(1), n), lambda t, i: _lane(lane, i, t["turn_hash"]))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))

    # Prefixes within the head, the root included: an array of bounded size.
    steps = convs.select("conv_id", "part", "first", "n", F.explode(F.sequence(F.lit(0), "n_head")).alias("depth"))
    last = F.when(F.col("depth") > 0, F.element_at("first", F.greatest(F.col("depth"), F.lit(1))))
    above = F.greatest(F.col("depth") - 1, F.lit(0))
    tops = steps.where("depth = 0").select("conv_id", "part", "depth", *(F.lit(0).cast("long").alias(k) for k in KEY), *(F.lit(None).cast("long").alias(p) for p in PARENT), F.lit(0).alias("size"), (F.col("n") == 0).alias("ends"))
    tops = tops.unionByName(steps.where("depth > 0").select(
        "conv_id", "part", "depth", *(upto(i, F.col("depth")).alias(k) for i, k in enumerate(KEY)), *(upto(i, above).alias(p) for i, p in enumerate(PARENT)), last["size"].alias("size"), (F.col("depth") == F.col("n")).alias("ends"),
    ))

    # Prefixes beyond it: a running aggregate in each piece, shifted by the head and the pieces before.
    pieces = counts.select("conv_id", "part").join(convs.select("conv_id", "h", "n_head", "n", *(upto(i, F.size("first")).alias(f"top{i}") for i in range(2))), "conv_id")
    own = turns.join(pieces, ["conv_id", "part"]).where(F.col("pos") >= F.col("h"))
    place = F.col("n_head") + F.col("pos") - F.col("h")
    own = own.withColumns({"place": place} | {f"own{i}": _lane(i, place, F.col("turn_hash")) for i in range(2)})
    sums = own.groupBy("conv_id", "part").agg(*(F.expr(f"bit_xor(own{i})").alias(f"all{i}") for i in range(2)))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *(F.coalesce(F.expr(f"bit_xor(all{i})").over(earlier), F.lit(0)).alias(f"earlier{i}") for i in range(2)))
    so_far = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({f"run{i}": F.expr(f"bit_xor(own{i})").over(so_far) for i in range(2)}).join(sums, ["conv_id", "part"])
    key = [F.col(f"top{i}").bitwiseXOR(F.col(f"earlier{i}")).bitwiseXOR(F.col(f"run{i}")) for i in range(2)]
    rest = run.select("conv_id", "part", (F.col("place") + 1).alias("depth"), *(k.alias(n) for k, n in zip(key, KEY, strict=True)), *(k.bitwiseXOR(F.col(f"own{i}")).alias(p) for i, (k, p) in enumerate(zip(key, PARENT, strict=True))), "size", (F.col("place") + 1 == F.col("n")).alias("ends"))
    return tops.unionByName(rest)


def merged(prefixes: DataFrame) -> DataFrame:
    """The trie's nodes ``k1, k2, p1, p2, depth, size, n_convs, conv_id``: a partial trie of each part, merged ``FAN`` parts at a time."""
    keep = [F.min(c).alias(c) for c in (*PARENT, "depth", "size", "conv_id")]
    parts = prefixes.agg(F.max("part")).first()[0]
    nodes = prefixes.groupBy("part", *KEY).agg(*keep, F.count("*").alias("n_convs"))
    while parts:
        nodes = nodes.groupBy(F.expr(f"part div {FAN}").alias("part"), *KEY).agg(*keep, F.sum("n_convs").alias("n_convs"))
        parts //= FAN
    return nodes.drop("part")


def end_lists(prefixes: DataFrame) -> DataFrame:
    """``k1, k2, n_ends, ends_sha256`` of nodes in which conversations end: the hash of their ids in ascending order, comma-joined.

    Ids are gathered in sorted blocks of bounded size; a node's blocks stream in order through one running hash, never held together.
    """
    blocks = prefixes.where("ends").groupBy(*KEY, F.expr(f"floor(conv_id / {BLOCK})").alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.count("*").alias("n"))

    def run(batches):
        key, state, n = None, None, 0
        for batch in batches:
            done = []
            for k1, k2, ids, more in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        done.append((*key, n, state.hexdigest()))
                    key, state, n = (k1, k2), hashlib.sha256(ids.encode()), more
                else:
                    state.update(b"," + ids.encode())
                    n += more
            yield _listed(done)
        if key is not None:
            yield _listed([(*key, n, state.hexdigest())])

    def _listed(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*KEY, "n_ends", "ends_sha256"])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, "k1 long, k2 long, n_ends long, ends_sha256 string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtrees of nodes ``k1, k2, p1, p2, depth, leaves, saved``, in rounds of doubled reach.

    ``p1, p2`` become the ancestor that a round adds to; a node of less depth than that has none.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        below = shared.where(F.col("depth") >= reach).groupBy(*(F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True))).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        found = shared.join(below, [*KEY], "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        reach *= 2
        if reach <= deepest:
            jumps = shared.where(F.col("depth") >= reach // 2).select(*(F.col(k).alias(f"at{p}") for p, k in zip(PARENT, KEY, strict=True)), *(F.col(p).alias(f"to{p}") for p in PARENT))
            deep, rest = found.where(F.col("depth") >= reach), found.where(F.col("depth") < reach)
            deep = deep.join(jumps, [F.col(p) == F.col(f"at{p}") for p in PARENT]).select(*KEY, *(F.col(f"to{p}").alias(p) for p in PARENT), "depth", "leaves", "saved")
            found = deep.unionByName(rest.select(*deep.columns))
        shared = stored(found, "rollup")
    return shared


def trie(prefixes: DataFrame) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256``."""
    prefixes = stored(prefixes, "prefixes")
    if prefixes.isEmpty():
        return prefixes.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, ends_sha256 string")
    nodes = stored(merged(prefixes), "nodes")
    children = nodes.where("depth > 0").groupBy(*(F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True))).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    nodes = nodes.join(children, [*KEY], "left").fillna(0, ["n_children", "lone"]).join(end_lists(prefixes), [*KEY], "left")
    nodes = stored(nodes, "nodes")
    shared = nodes.where("n_convs > 1")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("lone")).cast("long")
    sums = rolled_up(shared.select(*KEY, *PARENT, "depth", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).cast("long").alias("saved"))).select(*KEY, "leaves", "saved")
    parents = shared.select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)), F.col("conv_id").alias("parent"))
    found = nodes.join(sums, [*KEY], "left").join(parents, [*PARENT], "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
