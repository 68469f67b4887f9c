"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing and sharding, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that go on, with the columns of ``documents``; the last adds
``size, text_crc32, old_shard, shard, slot``. ``labels`` and ``benchmark`` are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alike, decontaminate, mixture, quality, reshard
from tidemark.llm.queries import WEIGHTS, language_domains
from tidemark.llm.store import positional, restored, stored

SHARDS = 40


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, names = positional(docs)
    return restored(quality.score(own, model, tuple(names[c] for c in ("text", "lang", "source", "n_chars"))).where("kept"), names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingle sets of Jaccard similarity 0.8 or more."""
    return alike.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontaminate.overlaps(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.where("leaked").select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("leak_id")) & (F.xxhash64(docs["text"]) == F.col("leak_hash"))
    return docs.join(found, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages have their target shares of tokens; none is left out."""
    own, names = positional(docs)
    rated = mixture.mixed(own, language_domains(spark, docs, sf_dir), WEIGHTS, whole=True, read=(names["doc_id"], names["text"]))
    return restored(rated.select(*names.values(), F.explode(F.sequence(F.lit(1), "copies"))), names)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard of near-equal bytes and their slot in it."""
    return reshard.reshard(reshard.by_source(docs), SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]
#: No stage can be expressed in SQL; the operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
