"""Compare a query's rows with those of its oracle SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(_plain(r[k]) for k in order)) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(_plain(v) for v in r)) for r in df.select(*names).collect())
