"""Operator 13: secrets in texts, by form and by novelty under zstandard primed with a dictionary of the corpus's identifiers.

Three forms are told by patterns (assignments to names such as ``token``, access keys, long hexadecimal runs). Beside them, candidates are
runs of token characters with a digit and a letter that stand close after a sensitive word. A candidate's marginal size is what it adds to the
compressed size of the text around it, with the dictionary at hand: identifiers that the corpus uses, and what the surroundings repeat, cost
next to nothing, random strings nearly all of their bytes. Candidates that cost at least ``NOVEL`` of their bytes are reported as ``novel``.

The dictionary holds the words that occur most often over all texts, counted whole, up to a fixed size. Words that are themselves shaped like
secrets (long with digits) are left out, so that a copied secret doesn't become an identifier.

Edge cases, all defined: a null text is an empty one; texts are scanned whole, whatever their length; offsets are code points, ends exclusive;
rows keep their id, null or repeated; spans of different kinds may overlap and are all kept; an empty table gives an empty dictionary.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textops import NO_WORD, chunks

# The forms, their names and the least length of what counts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|cred|bearer|private|signature|session|cookie|cert|login|salt")
NEAR = 48  # code points before a candidate in which a sensitive word counts
AROUND = 256  # code points on either side that a candidate is measured against
NOVEL = 0.5  # of a candidate's bytes
LEVEL = 3

WORDS, LONGEST = 4096, 32  # of the dictionary: words, bytes of a word
BATCH = 512


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts: runs of letters, digits and non-ASCII, A-Z lower-cased, of four to ``LONGEST`` bytes."""

    def run(batches):
        for batch in batches:
            for _, words in chunks(batch.column(0), NO_WORD):
                length = words.ends - words.starts
                fits = np.flatnonzero((length > 3) & (length <= LONGEST))
                keys, at, n = np.unique(words.hashes()[fits], return_index=True, return_counts=True)
                spans = fits[at]
                body = words.data.tobytes()
                found = [body[a:b] for a, b in zip(words.starts[spans].tolist(), words.ends[spans].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(n)], names=["word", "n"])

    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def identifiers(docs: DataFrame, text: str = "text") -> bytes:
    """The dictionary: the ``WORDS`` most frequent words of all texts, the most frequent last, where zstandard reaches them at least cost."""
    shaped = (F.length("word") >= 16) & F.col("word").cast("string").rlike("[0-9]")
    counts = stored(word_counts(docs, text), "words", BATCH).where(~shaped)
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return b" ".join(bytes(r["word"]) for r in reversed(top))


class Novelty:
    """Marginal compressed sizes under a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = {}
        if len(dictionary) >= 8:  # zstandard takes no shorter ones
            data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            primed = {"dict_data": data}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, **primed)

    def added(self, before: str, candidate: str, after: str) -> int:
        """The bytes that ``candidate`` adds between its surroundings."""
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "surrogatepass")))
        return size(before + after + candidate) - size(before + after)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            own = m.group()
            if not SENSITIVE.search(text[max(0, a - NEAR) : a].lower()) or not re.search("[0-9]", own) or not re.search("[A-Za-z]", own):
                continue
            if self.added(text[max(0, a - AROUND) : a], own, text[b : b + AROUND]) >= NOVEL * len(own):
                found.append((a, b))
        return found


def forms(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three forms, leftmost first within a kind and none overlapping in it; too short values drop out after the match."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    return found + [(m.start(), kind, m.end()) for kind, form in ((1, ACCESS), (2, HEX)) for m in form.finditer(text)]


def scan(docs: DataFrame, dictionary: bytes, read: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """``doc_id`` and ``found``, an array of ``(kind, start, end)`` in order of start and kind, for every text."""
    key, text = read
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            bounds, spans = [0], []
            for value in batch.column(1).to_pylist():
                if value:
                    spans += sorted(forms(value) + [(a, 3, b) for a, b in novelty.spans(value)])
                bounds.append(len(spans))
            columns = [pa.array([KINDS[s[1]] for s in spans], pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[2] for s in spans], pa.int64())]
            found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "found"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {kind}, found array<struct<kind string, start long, end long>>"), "secrets", BATCH)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, and ``n_novel``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count(KINDS[3]))
