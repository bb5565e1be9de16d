"""Side-by-side runs of a query and its DuckDB counterpart."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    theirs = database(sf_dir).sql(sql)
    names = list(theirs.columns)
    assert sorted(names) == cols
    assert ours == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in theirs.fetchall())
