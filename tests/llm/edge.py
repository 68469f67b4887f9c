"""Rows every operator has to live with."""

from __future__ import annotations

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, score double, words string, copies int, fp string, rank int, tokens int, packed int, kept boolean, size int, block int"


def edge_rows() -> list[tuple]:
    more = ("x", 3, 0.5, "w", 9, "f", 1, 2, 3, False, 4, 5)
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, LONG), (5, LONG), (None, "one two three four five six"), (None, None), (7, "  \t\n "), (8, "mit license"), (8, "mit license"), (9, "ÉÀ ü ß 漢字 😀"), (10, "a")]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 2 else 5, *more) for k, (i, t) in enumerate(texts)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
