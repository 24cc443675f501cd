"""Run a registered query and its SQL side by side and report the first difference."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (datetime, date)):
        return str(v)[:26]
    return "∅" if v is None else str(v)


def difference(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if not ours:
        return "no rows"
    if ours == theirs:
        return None
    wrong = next((a, b) for a, b in zip(ours + [None], theirs + [None]) if a != b)
    return f"{len(ours)} rows against {len(theirs)}; columns {cols}; first difference {wrong}"
