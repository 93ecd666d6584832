"""Holds a Spark result against DuckDB's for the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def oracle(sql, d, columns):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def rows(df):
    c = sorted(df.columns)
    return c, sorted((tuple(norm(x) for x in r) for r in df.select(*c).collect()), key=repr)
