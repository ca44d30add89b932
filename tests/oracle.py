"""Running a query and its SQL on the same folder."""

import glob
import math
import os

import duckdb


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return str(v)


def rows_of(values):
    return sorted((tuple(norm(x) for x in r) for r in values), key=lambda r: tuple((x is not None, x or "") for x in r))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def agree(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    got = rows_of(r.values() for r in df.select(*cols).toArrow().to_pylist())
    want = rows_of(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
