"""Lineage cuts that survive lost executors: tables written to the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import _file_system, shared_path

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
LISTED = "spark.sql.parquet.pushdown.inFilterThreshold"


def stored_at(df: DataFrame, name: str, batch: int | None = None, listed: int = 0) -> tuple[DataFrame, str]:
    """As ``stored``, with the path of what was written, for ``dropped``; ``listed`` is how many values of ``isin`` the readers of Parquet look for one by one."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = {c: spark.conf.get(c) for c in (BATCH, LISTED)}
    try:
        if batch:
            spark.conf.set(BATCH, str(batch))
        spark.conf.set(LISTED, str(max(listed, int(before[LISTED]))))
        df.write.parquet(path)
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    ``batch`` bounds the rows that Python tasks get at a time while it is written, for rows that are large.
    """
    return stored_at(df, name, batch)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stored_at`` has written and nothing reads any more."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def partitions(rows: int, each: int, least: int = 8) -> int:
    """How many groups keep about ``each`` rows in one."""
    return max(least, -(-rows // each))


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, so that no name among them can clash with others, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns ``positional`` renamed, under their own names."""
    return docs.select(*(F.col(new).alias(old) for old, new in names.items()))
