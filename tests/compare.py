"""Spark rows beside DuckDB rows of the same tables."""

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def duck_rows(sql: str, sf_dir: str = SMALL):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        got = con.execute(sql)
        columns = [d[0] for d in got.description]
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in got.fetchall()), key=repr)
