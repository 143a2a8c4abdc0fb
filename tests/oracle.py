"""Runs a query and its SQL side by side and compares their rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    names = sorted(x[0] for x in con.execute(f"DESCRIBE {sql}").fetchall())
    assert names == cols, (names, cols)
    theirs = sorted(map(repr, con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql}) t").fetchall()))
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, (len(bad), bad[:3])
