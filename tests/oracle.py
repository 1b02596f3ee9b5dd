"""Compare a query with its oracle in DuckDB."""

import datetime

import duckdb

from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if type(v).__name__ in ("Decimal", "float") else repr(v)


def rows_of_query(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


def rows_of_oracle(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
