"""Operator 7: licence scans through a positional index of rare words. DataFrame functions only.

The index has the words of licence templates with their positions. How rare each of them is comes from all
documents. A document is looked up by the rarest word of each template's mandatory key phrase, which has to be in place whole, so no
match can be missed; a posting's position against the word's place gives where the template would begin, and the template's other words are met at their
relative positions. Long texts are looked up piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .urlrules import LOWER, UPPER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE = 0.8
PIECE = 512  # words looked up at a time

# Phrases that count word for word, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Well-known licence wordings: label, text, mandatory key phrase.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]

# Template words too common in any English text to look a document up by.
COMMON = "a and any are by can copy fee for free in into is it of or person purpose source terms the this to under use v version with without you 0 2 4".split()


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants as literals, which no Python task has to read."""
    value = lambda x: F.array(*map(value, x)) if isinstance(x, list) else F.lit(x)
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(value(x).alias(n) for x, n in zip(r, names, strict=True))) for r in rows))))


def templates() -> list[tuple[int, str, list[str], int, int, bool]]:
    """``template, label, body, key_at, key_n, base``: words and key phrase of all phrases and templates."""
    rows = [(n, label, phrase.split(), 0, len(phrase.split()), True) for n, (phrase, label) in enumerate(PHRASES)]
    for n, (label, text, key) in enumerate(TEMPLATES, len(rows)):
        own, key = text.split(), key.split()
        at = next(k for k in range(len(own)) if own[k : k + len(key)] == key)
        rows.append((n, label, own, at, len(key), False))
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``.

    ``doc_id, n_words, n_base`` (all places of the phrases), ``first_word, last_word`` (smallest and largest start of
    such a place, words from 0, null where there is none), ``base_labels, labels`` (sorted, comma-joined; ``labels``
    has those of templates too, whose words agree at ``COVERAGE`` of the positions or more, key phrase included), ``score``
    (best agreement, 0 to 1; a phrase gives 1). A null text is an empty one and has no words. Repeated rows and null
    ids come back as they are; an empty table gives an empty result; columns other than the named ones are ignored.
    """
    rows = templates()
    rare = sorted({w for _, _, body, *_ in rows for w in body} - set(COMMON))
    longest = max(len(body) for _, _, body, *_ in rows)
    known = literal_rows(docs.sparkSession, rows, ["template", "label", "body", "key_at", "key_n", "base"])

    parsed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    parsed = parsed.select("row", "doc_id", F.size("words").alias("n_words"), "words", F.array_intersect("words", F.array(*map(F.lit, rare))).alias("found"))
    parsed = stored(parsed.withColumn("words", F.when(F.size("found") > 0, F.col("words"))), "licence_words")

    # how rare the index words are, over all documents; each template is looked up by the rarest of its key phrase
    number = parsed.count()
    df = parsed.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    in_key = (F.col("at") >= F.col("key_at")) & (F.col("at") < F.col("key_at") + F.col("key_n"))
    postings = known.select("*", F.posexplode("body").alias("at", "word")).where(F.col("word").isin(rare) & in_key)
    postings = postings.join(F.broadcast(df), "word", "left")
    postings = postings.withColumn("idf", F.log((F.lit(number) + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    ranked = Window.partitionBy("template").orderBy(F.desc("idf"), "word", "at")
    anchors = postings.withColumn("rank", F.row_number().over(ranked)).where("rank = 1").drop("rank", "idf", "df")
    looked_up = sorted({r.word for r in anchors.select("word").collect()})

    # pieces of the texts with as many words on either side as the longest template can need
    begin = lambda at: F.greatest(at - longest, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(PIECE)),
        lambda at: F.struct(at.alias("base"), begin(at).alias("left"), F.slice("words", begin(at) + 1, at - begin(at) + PIECE + longest).alias("words")),
    )
    asked = F.array(*map(F.lit, looked_up))
    pieces = parsed.where(F.arrays_overlap("found", asked)).select("row", F.explode(pieces).alias("p")).select("row", "p.*").where(F.arrays_overlap("words", asked))
    # places of the anchors in each piece, with the words around them
    hit = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), (F.col("left") + i).alias("pos"))), lambda x: x["word"].isin(looked_up) & (x["pos"] >= F.col("base")) & (x["pos"] < F.col("base") + PIECE))
    around = F.transform(
        hit,
        lambda x: F.struct(
            x["word"].alias("word"),
            x["pos"].alias("pos"),
            begin(x["pos"]).alias("left"),
            F.slice("words", begin(x["pos"]) - F.col("left") + 1, 2 * longest + 1).alias("near"),
        ),
    )
    places = pieces.select("row", F.explode(around).alias("p")).select("row", "p.*")
    met = places.join(F.broadcast(anchors), "word").withColumn("start", F.col("pos") - F.col("at"))
    agree = F.transform("body", lambda w, k: F.coalesce(F.get("near", F.col("start") - F.col("left") + k) == w, F.lit(False)))
    met = met.withColumn("agree", agree)
    met = met.select(
        "row", "label", "base", "start",
        (F.size(F.filter("agree", lambda x: x)) / F.size("body")).alias("covered"),
        F.forall(F.slice("agree", F.col("key_at") + 1, F.col("key_n")), lambda x: x).alias("key"),
    )
    met = met.where(F.col("key") & (F.col("covered") >= COVERAGE))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = met.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("covered").alias("score"),
    )
    return parsed.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
