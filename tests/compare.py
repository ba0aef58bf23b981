"""Queries against the same SQL in another engine."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("KALIBRA_TESTDATA", "/root/testdata")


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple("nan" if x != x else repr(x) if isinstance(x, float) else str(x) for x in r) for r in zip(*[table.column(c).to_pylist() for c in names]))


def assert_same(spark, query, sql: str, sf: str = "sf0.001") -> None:
    folder = f"{DATA}/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    own, other = query(spark, folder).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(own.column_names) == sorted(other.column_names)
    a, b = rows(own), rows(other)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
