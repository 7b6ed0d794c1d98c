"""Helpers of the tests."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    """Columns in order of name, and sorted rows of a query on DuckDB."""
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if not os.path.exists(path):
            continue
        if os.path.isdir(path):
            path += "/*.parquet"
        c.execute(f"create view {t} as select * from '{path}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sort_rows([tuple(row[i] for i in order) for row in r.fetchall()])


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sort_rows([tuple(r[n] for n in names) for r in df.collect()])


def sort_rows(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return a == b


def assert_same(df, sf: str, sql: str) -> None:
    names, got = spark_rows(df)
    expected_names, expected = oracle_rows(sf, sql)
    assert names == expected_names
    assert len(got) == len(expected)
    wrong = [(x, y) for x, y in zip(got, expected, strict=True) if not all(map(close, x, y))]
    assert not wrong, wrong[:3]
