"""Compares a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return v
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(frame, columns):
    return sorted(str([_cell(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


def assert_same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
    assert len(got)
    return got
