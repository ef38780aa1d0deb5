"""Compares queries with their SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return str(v)


def difference(con, df, sql):
    """None if the rows agree, else what differs."""
    cols = sorted(df.columns)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    rows = res.fetchall()
    if sorted(names) != cols:
        return f"columns {sorted(names)} and {cols}"
    place = [names.index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in place]) for r in rows)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if got == want:
        return None
    return f"{len(got)} rows, SQL {len(want)}; only here {sorted(set(got) - set(want))[:2]}; only there {sorted(set(want) - set(got))[:2]}"
