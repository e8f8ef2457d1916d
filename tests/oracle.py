"""Comparison of a query with its SQL in another engine."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder, names=TABLES):
    con = duckdb.connect()
    for t in names:
        path = folder / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


def assert_same(con, df, sql):
    con.execute(sql)
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(con.fetchall(), columns)
