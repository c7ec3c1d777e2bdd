"""Query results against their SQL, as multisets of normalised rows."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "~"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    return str(v.tolist() if isinstance(v, np.ndarray) else v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


def check(name, query, sql, spark, con, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), name
    ints = {c: ("~" in map(cell, mine[c])) for c in mine.columns}
    for c, has_null in ints.items():
        if has_null and mine[c].dtype.kind == "f":
            theirs[c] = theirs[c].astype("float64")
    assert rows(mine) == rows(theirs), name
