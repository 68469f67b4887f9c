"""Readers and writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks


def test_csv_series_drops_junk(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,X\n2026-01-01,1.5\n2026-01-02,.\nnope,3\n2026-01-03,\n2026-01-04,2\n")
    got = readers.csv_series(spark, str(tmp_path / "s.csv"), "x").orderBy("period").collect()
    assert [(r.series_id, str(r.period), r.value) for r in got] == [("x", "2026-01-01", 1.5), ("x", "2026-01-04", 2.0)]


def test_json_series_and_paged_source(spark, tmp_path):
    data = [{"period": "2026-01-01", "value": "3"}, {"period": "2026-01-02", "value": None}, {"period": "bad", "value": "1"}]
    for k in (0, 10):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"response": {"data": data if not k else [{"period": "2026-02-01", "value": "7"}]}}))
    assert [(str(r.period), r.value) for r in readers.json_series(spark, str(tmp_path / "p0.json"), "x").collect()] == [("2026-01-01", 3.0)]
    spark.dataSource.register(readers.PagedSeries)
    got = spark.read.format("paged_series").option("url", f"file://{tmp_path}/p{{offset}}.json").option("pages", "2").option("size", "10").load()
    assert sorted((str(r.period), r.value) for r in got.collect()) == [("2026-01-01", 3.0), ("2026-02-01", 7.0)]


def test_the_last_good_copy_stands_in(spark, tmp_path):
    good, path = [(1, "a")], str(tmp_path / "kept")
    load = lambda: spark.createDataFrame(good, "k int, v string")

    def failing():
        return spark.read.format("paged_series").option("url", f"file://{tmp_path}/none{{offset}}.json").option("pages", "1").load()

    spark.dataSource.register(readers.PagedSeries)
    with pytest.raises(Exception):
        readers.with_last_good(spark, path, failing)
    got, fresh = readers.with_last_good(spark, path, load)
    assert fresh and [tuple(r) for r in got.collect()] == good
    path2 = str(tmp_path / "pages")
    (tmp_path / "q0.json").write_text(json.dumps({"response": {"data": [{"period": "2026-02-01", "value": "7"}]}}))
    pages = lambda: spark.read.format("paged_series").option("url", f"file://{tmp_path}/q{{offset}}.json").option("pages", "1").load()
    assert readers.with_last_good(spark, path2, pages)[1]
    (tmp_path / "q0.json").unlink()
    got, fresh = readers.with_last_good(spark, path2, pages)
    assert not fresh and [r.value for r in got.collect()] == [7.0]


def test_json_state(spark, tmp_path):
    path = tmp_path / "state.json"
    assert readers.json_state(spark, str(path), "price double").count() == 0
    path.write_text(json.dumps({"records": {"2026-01-01T00:00:00Z": {"price": 1.0}}}))
    assert [r.record.price for r in readers.json_state(spark, str(path), "price double").collect()] == [1.0]
    path.write_text("{broken")
    with pytest.raises(Exception):
        readers.json_state(spark, str(path), "price double", strict=True).collect()


def test_json_documents_that_are_whole(spark, tmp_path):
    assert readers.json_documents(spark, str(tmp_path / "none"), "a int").count() == 0
    for name, text in {"a.json": '{\n "a": 1,\n "b": {"x": {"n": 2}}}', "b.json": '{"a": 1, "b"', "c.json": "[]", "d.json": '{"b": null}', "e.json": ""}.items():
        (tmp_path / name).write_text(text)
    got = {r.file: r.doc for r in readers.json_documents(spark, str(tmp_path), "a int, b map<string, struct<n: int>>").collect()}
    assert got["a.json"].a == 1 and got["a.json"].b["x"].n == 2 and got["d.json"].a is None and "b.json" not in got and "e.json" not in got


def test_first_available(spark):
    a = spark.createDataFrame([("x", 1)], "series_id string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "series_id string, v int")
    assert sorted(map(tuple, readers.first_available([a, b]).collect())) == [("x", 1), ("y", 3)]


def test_allowed_path(tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert readers.allowed_path(str(tmp_path / "a.json"), str(tmp_path), frozenset({"a.json"})).endswith("a.json")
    for bad in ("b.json", "../a.json"):
        with pytest.raises(ValueError):
            readers.allowed_path(str(tmp_path / bad), str(tmp_path), frozenset({"a.json"}))


def test_retry_only_on_rate_limits():
    calls = []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("HTTP 429 Too Many Requests")
        return b"ok"

    waits = []
    assert readers.with_retry(fetch, sleep=waits.append) == b"ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        readers.with_retry(lambda: (_ for _ in ()).throw(OSError("HTTP 500")), sleep=waits.append)
    assert len(waits) == 2


def test_write_if_changed_and_upserts(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.write_if_changed(a, path) and not sinks.write_if_changed(a.orderBy(F.desc("k")), path)
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, sinks.upserted(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, sinks.inserted(a, b, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    sinks.report_json(a, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_failover_takes_the_first_positive_price():
    told, waits = {"a": [float("nan"), OSError("down")], "b": [-1.0, 81.25]}, []

    def fetch(host):
        x = told[host].pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert readers.with_failover(["a", "b"], fetch, sleep=waits.append) == ("b", 81.25) and waits == [1.0]
    with pytest.raises(ValueError):
        readers.with_failover(["a"], lambda host: 0.0, sleep=waits.append)


def test_versions_are_claimed_once(spark, tmp_path):
    path = str(tmp_path / "published")
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (2, "y")], [(2, "z"), (3, "w")]))
    assert sinks.published(spark, path) is None and sinks.publish_upsert(a, path, ["k"]) == 1
    assert sinks.publish_upsert(b, path, ["k"]) == 2
    assert sorted(map(tuple, sinks.published(spark, path).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(sinks.Conflict):
        sinks.publish(a, path, 1)
    assert sinks.versions(spark, path) == [1, 2]


def test_a_dead_claim_is_taken_over_and_null_keys_are_upserted_once(spark, tmp_path):
    path = str(tmp_path / "published")
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (None, "y")], [(None, "z"), (3, "w")]))
    (tmp_path / "published").mkdir()
    (tmp_path / "published" / "claim-1").write_text("dead")
    with pytest.raises(sinks.Conflict):
        sinks.publish(a, path, 0)
    assert sinks.publish(a, path, 0, now=lambda: __import__("time").time() + 7200) == 1
    for _ in range(2):
        sinks.publish_upsert(b, path, ["k"])
    assert sorted(map(str, map(tuple, sinks.published(spark, path).collect()))) == ["(1, 'x')", "(3, 'w')", "(None, 'z')"]
    assert sinks.versions(spark, path) == [1, 2, 3]
    assert sorted(map(str, map(tuple, sinks.inserted(a, b, ["k"]).collect()))) == ["(1, 'x')", "(3, 'w')", "(None, 'y')"]


def test_package_is_shipped_and_scratch_is_cleared(spark):
    from tidemark.sources import scratch

    scratch.ship(spark)
    where = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("tidemark.functions.folds", fromlist=["x"]).__name__).collect()
    assert where == ["tidemark.functions.folds"]
    path = scratch.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    scratch.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
