"""Compares a query's rows with those of its SQL twin."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, connection, sql: str) -> None:
    got, names = [tuple(r) for r in df.collect()], df.columns
    result = connection.execute(sql)
    wanted_names = [d[0] for d in result.description]
    assert sorted(names) == sorted(wanted_names)
    assert ordered(got, names) == ordered(result.fetchall(), wanted_names)
