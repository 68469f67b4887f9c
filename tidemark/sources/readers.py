"""Readers of series and state files. Types are declared; what can't be read as a number is missing, never a failure, unless a reader is strict."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from .sinks import publish, published, versions

SERIES = "series_id string, period date, value double"


def tidy(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Series rows with a usable date and number, the last of each date in ``order`` (any, if None)."""
    rows = rows.where("period IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    if order is None:
        return rows.dropDuplicates(["series_id", "period"])
    last = Window.partitionBy("series_id", "period").orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", order)


def csv_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A two-column CSV file (date, value, with a header) as ``series_id, period, value``; ``.`` and other junk is dropped."""
    raw = spark.read.schema("period string, value string").option("header", True).csv(path)
    rows = raw.select(F.lit(series_id).alias("series_id"), F.try_to_date("period").alias("period"), F.expr("try_cast(value AS double)").alias("value"))
    return tidy(rows)


def json_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A JSON answer ``{"response": {"data": [{"period", "value"}]}}`` as ``series_id, period, value``."""
    shape = "response struct<data: array<struct<period: string, value: string>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("response.data").alias("r"))
    rows = rows.select(F.lit(series_id).alias("series_id"), F.try_to_date("r.period").alias("period"), F.expr("try_cast(r.value AS double)").alias("value"))
    return tidy(rows)


def json_state(spark: SparkSession, path: str, record: str, strict: bool = False) -> DataFrame:
    """A JSON map of records by timestamp, bare or under ``records``, as ``ts, record`` rows in no order.

    A missing file is empty. With ``strict`` a file that isn't such a map raises, so that it is never overwritten as if empty.
    """
    shape = f"records map<string, struct<{record}>>"
    try:
        raw = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"ts timestamp, record struct<{record}>")
    rows = raw.select(F.explode("records").alias("ts", "record"))
    return rows.select(F.try_to_timestamp("ts").alias("ts"), "record")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, doc`` of the JSON documents under ``path``, one a file whatever its line breaks; a missing path has none, and what isn't such a document is left out."""
    try:
        files = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"file string, doc struct<{schema}>")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    found = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), parsed.alias("doc")).where("doc IS NOT NULL AND doc._broken IS NULL")
    return found.withColumn("doc", F.col("doc").dropFields("_broken"))


def first_available(candidates: list[DataFrame]) -> DataFrame:
    """Rows of the first candidate that has any for each series, in one pass over their union."""
    tagged = [df.withColumn("_prio", F.lit(k)) for k, df in enumerate(candidates)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    best = F.min("_prio").over(Window.partitionBy("series_id"))
    return rows.withColumn("_best", best).where("_prio = _best").drop("_prio", "_best")


def allowed_path(path: str, root: str, names: frozenset[str]) -> str:
    """``path`` if it is one of ``names`` directly in ``root`` once links are followed; else an error."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.dirname(real) != base or os.path.basename(real) not in names:
        raise ValueError(f"{path} is not an allowed file")
    return real


def with_retry(fetch: Callable[[], bytes], waits: tuple[float, ...] = (2.0, 4.0), sleep: Callable[[float], None] = time.sleep) -> bytes:
    """``fetch()``, again after each wait while the failure says that the rate limit is reached."""
    for wait in waits:
        try:
            return fetch()
        except Exception as error:
            text = str(error).lower()
            if "429" not in text and "rate limit" not in text and "too many requests" not in text:
                raise
            sleep(wait)
    return fetch()


def with_last_good(spark: SparkSession, path: str, load: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """What ``load()`` gives, kept as a new version under ``path``, and True; where it fails, the newest version kept before, and False.

    The failure is raised if there is none. A reader of the last good copy never sees one half written.
    """
    try:
        known = versions(spark, path)
        publish(load(), path, known[-1] if known else 0)
        return published(spark, path), True
    except Exception:
        last = published(spark, path)
        if last is None:
            raise
        return last, False


def with_failover(hosts: list[str], fetch: Callable[[str], float], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str, float]:
    """The first positive finite price that ``fetch(host)`` gives and its host: all hosts in turn, ``attempts`` times; the last error if there is none."""
    failure: Exception = ValueError("no host")
    for attempt in range(attempts):
        for host in hosts:
            try:
                price = float(fetch(host))
                if 0 < price < float("inf"):
                    return host, price
                failure = ValueError(f"{host} gave {price}")
            except Exception as error:
                failure = error
        if attempt + 1 < attempts:
            sleep(float(attempt + 1))
    raise failure


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedSeries(DataSource):
    """A paged REST answer as a table: a partition for each page, options ``url`` (with ``{offset}``), ``pages``, ``size`` and ``series_id``."""

    @classmethod
    def name(cls) -> str:
        return "paged_series"

    def schema(self) -> str:
        return SERIES

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Page]:
        size = int(self.options.get("size", "5000"))
        return [_Page(k * size) for k in range(int(self.options.get("pages", "3")))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import datetime
        import json

        url = self.options["url"].replace("{offset}", str(partition.offset))
        body = json.loads(with_retry(lambda: urllib.request.urlopen(url, timeout=30).read()))
        for row in body.get("response", {}).get("data", []):
            try:
                yield self.options.get("series_id", "series"), datetime.date.fromisoformat(row["period"]), float(row["value"])
            except (KeyError, TypeError, ValueError):
                continue
