"""Runs a registered query and its DuckDB counterpart, and compares rows whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description), name
    assert len(got) == len(want), f"{name}: {len(got)} rows, not {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, f"{name}: {len(bad)} rows differ, such as {bad[0]}"
