"""Spark rows against DuckDB's for one query."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in data)


def differences(spark_df, con, sql: str) -> list[str]:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    out = []
    if sorted(spark_df.columns) != sorted(rel.columns):
        out.append(f"columns {sorted(spark_df.columns)} and {sorted(rel.columns)}")
    if got != want:
        odd = [("spark", x) for x in sorted(set(got) - set(want))[:2]] + [("duckdb", x) for x in sorted(set(want) - set(got))[:2]]
        out.append(f"{len(got)} and {len(want)} rows: {odd}")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    out += [f"{c} is {k} and {types[c]}" for c, k in spark_df.dtypes if c in types and kinds.get(k, types[c]) != types[c]]
    return out
