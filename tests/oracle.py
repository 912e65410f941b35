"""Run a registered query beside its SQL and compare, as the driver does."""

from pathlib import Path

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def norm(x):
    return round(x, 9) if isinstance(x, float) else x


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, want = sql_rows(duck(sf_dir), sql)
    assert sorted(df.columns) == names
    assert rows(df) == want
