"""Writers of results and state."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint(df: DataFrame) -> str:
    """A digest of all rows whatever their order: SHA-256 of the row count and the sum of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    return df.agg(F.sha2(F.concat_ws("|", F.count("*"), F.coalesce(F.sum(row), F.lit(0))), 256)).first()[0]


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write ``df`` as Parquet unless ``path`` holds the same rows already; whether it was written."""
    spark = df.sparkSession
    try:
        if fingerprint(spark.read.parquet(path).select(*df.columns)) == fingerprint(df):
            return False
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("overwrite").parquet(path)
    return True


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys ``other`` doesn't have; null keys are equal to each other."""
    known = other.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return rows.join(known, same, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose keys it doesn't have; null keys are equal to each other."""
    return _without(old, new, keys).unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it doesn't have; null keys are equal to each other."""
    return old.unionByName(_without(new, old, keys))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a log of upserts."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


class Conflict(Exception):
    """Another writer has published the version that was to be written."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions published under ``path``, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version under ``path``, or None."""
    known = versions(spark, path)
    if not known:
        return None
    owner = spark.read.text(f"{path}/done-{known[-1]}").first()[0]
    return spark.read.parquet(f"{path}/version-{known[-1]}-{owner}")


CLAIM_AGE = 3600.0  # seconds after which a claim without a result is dead


def _claimed(files, claim, owner: str, age: float, now) -> bool:
    """Whether ``owner`` holds ``claim``: created by it just now, or taken over from a writer that has been silent for ``age``.

    A takeover renames the dead claim away, which only one writer can do, and creates it anew.
    """
    try:
        out = files.create(claim, False)
    except Exception:
        if not files.exists(claim):
            raise
        if now() - files.getFileStatus(claim).getModificationTime() / 1000 < age:
            return False
        if not files.rename(claim, claim.suffix(f".{owner}.dead")):
            return False
        return _claimed(files, claim, owner, age, now)
    out.write(bytearray(owner.encode()))
    out.close()
    return True


def publish(df: DataFrame, path: str, after: int, age: float = CLAIM_AGE, now: Callable[[], float] = time.time) -> int:
    """Write ``df`` as the version that follows ``after`` (0 for the first); ``Conflict`` if another writer has published or is writing it.

    A claim is a file that only one writer can create; one older than ``age`` seconds without a result is taken over. Each writer writes to a
    folder of its own and the version's second file, which again only one can create, says whose counts, so a writer thought dead can't harm it.
    """
    spark, version, owner = df.sparkSession, after + 1, uuid.uuid4().hex
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = at(f"{path}/done-{version}")
    if files.exists(done) or not _claimed(files, at(f"{path}/claim-{version}"), owner, age, now):
        raise Conflict(f"version {version} of {path} is taken")
    claim = f"{path}/claim-{version}"
    try:
        df.write.parquet(f"{path}/version-{version}-{owner}")
    except Exception:
        if [r[0] for r in spark.read.text(claim).collect()] == [owner]:  # not taken over: given up
            files.delete(at(claim), False)
        raise
    try:
        out = files.create(done, False)
    except Exception as error:
        if not files.exists(done):
            raise
        raise Conflict(f"version {version} of {path} was taken over") from error
    out.write(bytearray(owner.encode()))
    out.close()
    return version


def publish_upsert(new: DataFrame, path: str, keys: list[str], tries: int = 3) -> int:
    """Upsert ``new`` into the newest version under ``path`` and publish the result, again from the start where another writer came first."""
    spark = new.sparkSession
    for last in reversed(range(tries)):
        known, old = versions(spark, path), published(spark, path)
        try:
            return publish(new if old is None else upserted(old, new, keys), path, known[-1] if known else 0)
        except Conflict:
            if not last:
                raise
    raise AssertionError("unreachable")


def report_json(df: DataFrame, path: str) -> None:
    """Each row as one JSON line, fields in order of name."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
