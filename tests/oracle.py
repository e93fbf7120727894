"""Spark results against DuckDB results, as multisets of rows with columns by name."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    names = sorted(frame.columns)
    return sorted(tuple(text(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def compare(spark, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
