"""Operator 11: vectors compressed to short codes, a codebook for each part of a vector, by Yinyang Lloyd.

Components become integers, ``floor(4096 * x)``, and vectors are cut into consecutive parts. A part's codebook starts as that part of the
vectors with the smallest ids; each round assigns every part to its nearest entry and moves the entries to their parts' means.

All distances that decide are integers. Between rounds a part keeps an upper bound on the distance to its entry and, for each group of
entries, a lower bound on the distance to the group's other entries. Entries move, so bounds drift; only groups whose drifted bound fails
against the upper bound are scanned, ties included, and the nearest is told by integers, the lower index first. Bounds are rounded outward.

Edge cases, all defined: vectors that are null, empty or hold a null, NaN or infinite component are left out, and so are those whose length
isn't that of the kept vector with the smallest id; where the parts can't be equal they differ by one component; components beyond
``limit`` (2**27.5 at 64 dimensions) count as ``limit``, so that no sum of squares overflows; null ids come after all others; equal ids are
ordered by their vectors; with fewer vectors than entries the codebooks are smaller; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dropped, stored, stored_at

SCALE = 4096
BATCH_COMPONENTS = 1 << 20  # of the vectors that a Python task gets at a time
SLACK = 1e-9  # of bounds against rounding


@dataclass(frozen=True)
class Codebooks:
    """Integer entries of all parts, ``(parts, entries, width)``, zero beyond a part's length; ``cuts`` are the parts' bounds in a vector."""

    entries: np.ndarray
    cuts: tuple[int, ...]

    def sha256(self) -> str:
        """Of all decimal components by part, entry and position within the part, comma-joined."""
        lengths = np.diff(self.cuts)
        flat = [str(v) for p, own in enumerate(self.entries) for entry in own for v in entry[: lengths[p]].tolist()]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def limit(dimensions: int) -> int:
    """The largest component that keeps a vector's sum of squared differences below 2**63."""
    return int(np.sqrt(2.0**63 / dimensions) / 2) - 1


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def _integers(vector: Column, most: int) -> Column:
    edge = F.lit(float(most))
    return F.transform(vector, lambda x: F.floor(F.greatest(-edge, F.least(edge, x * SCALE))).cast("int"))


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry of one part's codebook: a few rounds of means, begun at entries spread over the book."""
    wanted = min(groups, len(book))
    middle = book[np.linspace(0, len(book) - 1, wanted).astype(int)].astype(float)
    own = np.zeros(len(book), dtype=int)
    for _ in range(5):
        own = ((book[:, None, :] - middle[None]) ** 2.0).sum(-1).argmin(1)
        for g in range(wanted):
            if (own == g).any():
                middle[g] = book[own == g].mean(0)
    return own


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = x[:, None, :] - entries[None]
    return (gap * gap).sum(-1)


def nearest(x: np.ndarray, book: np.ndarray, groups: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> int:
    """Reassign one part of a batch in place and return how many distances were computed.

    ``x`` (rows, width) and ``book`` (entries, width) are integers, ``moved`` is how far each entry moved since the bounds were true;
    ``code`` is each row's entry, ``upper`` at least the distance to it, ``lower`` (rows, groups) at most the distance to any other entry of a group.
    """
    n_groups = lower.shape[1]
    upper += moved[code]
    for g in range(n_groups):
        lower[:, g] -= moved[groups == g].max(initial=0.0)
    left = np.flatnonzero(lower.min(1, initial=np.inf) <= upper * (1 + SLACK))
    if not len(left):
        return 0
    gap = x[left] - book[code[left]]
    best = (gap * gap).sum(-1)
    upper[left] = np.sqrt(best) * (1 + SLACK)
    seen = len(left)
    open_ = lower[left].min(1) <= upper[left] * (1 + SLACK)
    left, best = left[open_], best[open_]
    before, before_best, ceiling = code[left], best, upper[left] * (1 + SLACK)
    chosen, best = before.copy(), best.copy()
    scanned = lower[left] <= ceiling[:, None]
    firsts, first_at, seconds = (np.full((len(left), n_groups), v) for v in (-1, -1, -1))
    for g in range(n_groups):
        members, rows = np.flatnonzero(groups == g), np.flatnonzero(scanned[:, g])
        if not len(members) or not len(rows):
            continue
        d = _squares(x[left[rows]], book[members])
        seen += d.size
        at = d.argmin(1)
        least = d[np.arange(len(rows)), at]
        firsts[rows, g], first_at[rows, g] = least, members[at]
        if len(members) > 1:
            d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
            seconds[rows, g] = d.min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (members[at] < chosen[rows]))
        best[rows[better]], chosen[rows[better]] = least[better], members[at[better]]
    others = np.where(first_at == chosen[:, None], seconds, firsts)  # the nearest of a scanned group but for the row's own entry
    bound = np.where(others < 0, np.inf, np.sqrt(np.maximum(others, 0)) * (1 - SLACK))
    new = np.where(scanned, bound, lower[left])
    home, switched = groups[before], (chosen != before) & ~scanned[np.arange(len(left)), groups[before]]
    rows = np.flatnonzero(switched)  # the entry left behind is now one of its unscanned group's others
    new[rows, home[rows]] = np.minimum(new[rows, home[rows]], np.sqrt(before_best[rows]) * (1 - SLACK))
    lower[left], code[left] = new, chosen
    upper[left] = np.sqrt(best) * (1 + SLACK)
    return seen


def _stacked(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a column of equally long binary values."""
    column = column.cast(pa.large_binary())
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).view(dtype)


def _packed(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    width = flat.itemsize * int(np.prod(flat.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.py_buffer(flat.tobytes())])


def _outward(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bounds as single precision, the upper one first, rounded away from what they bound."""
    both = np.concatenate([upper[:, :, None], lower], axis=2)
    narrow = both.astype(np.float32)
    sides = np.full(both.shape[2], -np.inf, dtype=np.float32)
    sides[0] = np.inf
    return np.nextafter(narrow, sides)


class _Parts:
    """The layout of vectors: bounds of the parts and how integers are stored."""

    def __init__(self, dimensions: int, parts: int, narrow: bool):
        self.cuts = tuple(p * dimensions // parts for p in range(parts + 1))
        self.width = max(np.diff(self.cuts))
        self.dtype = np.int16 if narrow else np.int32

    def split(self, x: np.ndarray) -> np.ndarray:
        """``(rows, dimensions)`` as ``(parts, rows, width)``, zero beyond a part's length."""
        out = np.zeros((len(self.cuts) - 1, len(x), self.width), dtype=np.int64)
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            out[p, :, : b - a] = x[:, a:b]
        return out


def _pass(rows: DataFrame, layout: _Parts, book: np.ndarray, groups: np.ndarray, moved: np.ndarray | None, label_type: str, last: bool) -> DataFrame:
    """One assignment of all rows. Unless it is the last, its rows hold the next pass's state, and one for each slot of a task's partial sums."""
    parts, k, width = book.shape
    n_groups, slots = int(groups.max()) + 1, parts * k * (width + 1)

    def run(batches):
        sums = np.zeros(slots, dtype=np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            n, raw = batch.num_rows, batch.column(2)
            if moved is None:
                flat = raw.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                code = np.zeros((n, parts), dtype=np.uint8)
                upper, lower = np.full((n, parts), np.inf), np.full((n, parts, n_groups), -np.inf)
            else:
                flat, code = _stacked(raw, layout.dtype), _stacked(batch.column(3), np.uint8).copy()
                bounds = _stacked(batch.column(4), np.float32).astype(float).reshape(n, parts, n_groups + 1)
                upper, lower = bounds[:, :, 0].copy(), bounds[:, :, 1:].copy()
            cut = layout.split(flat)
            error = np.zeros(n, dtype=np.int64)
            for p in range(parts):
                own, up, low = code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                nearest(cut[p], book[p], groups[p], own, up, low, np.zeros(k) if moved is None else moved[p])
                code[:, p], upper[:, p], lower[:, p] = own, up, low
                if last:
                    gap = cut[p] - book[p][own]
                    error += (gap * gap).sum(-1)
                else:
                    own_sums = sums.reshape(parts, k, width + 1)[p]
                    np.add.at(own_sums, own, np.concatenate([cut[p], np.ones((n, 1), np.int64)], axis=1))
            ids, labels = batch.column(0), batch.column(1)
            if last:
                digits = [bytes(r).hex() for r in code] if k > 16 else ["".join("%02x" % v for v in r) for r in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digits), pa.array(error)], names=["vec_id", "label", "code", "error"])
            else:
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
                packed = [_packed(flat.astype(layout.dtype)), _packed(code), _packed(_outward(upper, lower))]
                yield pa.RecordBatch.from_arrays([ids, labels, *packed, *none], names=["vec_id", "label", "x", "code", "bounds", "slot", "value"])
        if not last and schema is not None:
            used = np.flatnonzero(sums)
            empty = [pa.nulls(len(used), t) for t in (schema.field(0).type, schema.field(1).type, pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["vec_id", "label", "x", "code", "bounds", "slot", "value"])

    more = "code string, error long" if last else "x binary, code binary, bounds binary, slot int, value long"
    return rows.mapInArrow(run, f"vec_id long, label {label_type}, {more}")


def _moved_to(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The entries moved to their parts' floored means; unused ones stay. The sums are a row for each component of the codebooks."""
    parts, k, width = book.shape
    sums = np.zeros(parts * k * (width + 1), dtype=np.int64)
    for slot, value in state.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("value")).collect():
        sums[slot] = value
    sums = sums.reshape(parts, k, width + 1)
    n = sums[:, :, width:]
    return np.where(n > 0, sums[:, :, :width] // np.maximum(n, 1), book)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, read: tuple[str, str, str] = ("vec_id", "embedding", "label")) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every usable vector (a code's entries as two hex digits each, by part), and the codebooks.

    ``read`` names the columns of ids, vectors and labels; others are ignored. At most 256 entries. Each round reads the rows' state from the
    shared folder and writes the next one beside the tasks' partial sums, so a lost executor costs a pass at most; an older state is removed.
    """
    spark = vectors.sparkSession
    key, vector, label = read
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    label_type = rows.schema["label"].dataType.simpleString()
    order = [F.col("vec_id").asc_nulls_last(), F.size("v"), "v"]
    first = rows.orderBy(*order).select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], f"vec_id long, label {label_type}, code string, error long"), Codebooks(np.zeros((parts, 0, 0), np.int64), (0,) * (parts + 1))
    dimensions = first[0]
    rows = rows.where(F.size("v") == dimensions)
    rows = rows.select("vec_id", "label", _integers(F.col("v"), limit(dimensions)).alias("x"))
    widest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    layout = _Parts(dimensions, parts, widest < 1 << 15)
    seeds = np.array([r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    book = layout.split(seeds)
    group = np.stack([grouped(own, groups) for own in book])
    batch = max(64, BATCH_COMPONENTS // dimensions)
    moved, path = None, ""
    for _ in range(rounds):
        rows, new_path = stored_at(_pass(rows, layout, book, group, moved, label_type, False), "codes", batch)
        if path:
            dropped(spark, path)
        path, before = new_path, book
        book = _moved_to(rows, book)
        moved = np.sqrt(((book - before) ** 2.0).sum(-1)) * (1 + SLACK)
        rows = rows.where("slot IS NULL")
    found = stored(_pass(rows, layout, book, group, moved if rounds else None, label_type, True), "coded", batch)
    if path:
        dropped(spark, path)
    return found, Codebooks(book, layout.cuts)


def digest(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: errors summed over equal labels, null labels together."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
