"""Spark-vs-DuckDB parity check for the registered queries (mirrors the driver's compare).

Usage: ``python tests/parity.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return v


def duck_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, name: str, sf_dir: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    t1 = time.time()
    dcols, drows = duck_rows(sf_dir, sql)
    out["duck_sec"] = round(time.time() - t1, 2)
    out["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    key = lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)
    a = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=key)
    b = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=key)
    if a == b:
        out["status"] = "MATCH"
    else:
        sa, sb = set(a), set(b)
        out["status"] = "MISMATCH"
        out["only_spark"] = list(sa - sb)[:3]
        out["only_duck"] = list(sb - sa)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from quarry.session import local_session

    spark = local_session(8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in names or list(qs):
        try:
            res = compare(spark, name, sf_dir, qs[name], sqls.get(name))
        except Exception as exc:  # report and go on
            res = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        print(res, flush=True)


if __name__ == "__main__":
    main(sys.argv)
