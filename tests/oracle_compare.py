"""Run a registered query in Spark and its SQL oracle in DuckDB and compare
row count, column names and the multiset of rows (floats to 6 places)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=repr)


def compare(spark, con, key: str, query, sql: str | None, sf_dir: str) -> dict:
    df = query(spark, sf_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    out = {"key": key, "rows": len(got)}
    if sql is None:
        out["ok"] = True
        out["check"] = "rows-only"
        return out
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    exp = res.fetchall()
    out["oracle_rows"] = len(exp)
    out["cols_ok"] = sorted(cols) == sorted(ocols)
    if not out["cols_ok"]:
        out["ok"] = False
        out["detail"] = f"spark {cols} vs oracle {ocols}"
        return out
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = [ocols.index(cols[i]) for i in order]
    a = rows_key([tuple(r[i] for i in order) for r in got])
    b = rows_key([tuple(r[i] for i in oorder) for r in exp])
    out["ok"] = a == b
    if not out["ok"]:
        diff_a = [r for r in a if r not in b][:3]
        diff_b = [r for r in b if r not in a][:3]
        out["detail"] = f"spark-only {diff_a} oracle-only {diff_b}"
    return out
