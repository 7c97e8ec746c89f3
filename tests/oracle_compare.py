"""Run a catalogue query on Spark and its SQL oracle on DuckDB; compare row
count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()[:16], keys


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> dict:
    sdf = query(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    out = {"name": name, "rows_spark": len(srows), "rows_oracle": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    hs, ks = _hash(srows, scols)
    hd, kd = _hash(drows, dcols)
    out["hash_match"] = hs == hd and out["cols_match"]
    out["ok"] = out["hash_match"] and len(srows) == len(drows)
    if not out["ok"]:
        out["spark_cols"], out["oracle_cols"] = scols, dcols
        sa, sb = set(ks), set(kd)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_oracle"] = sorted(sb - sa)[:3]
    return out


if __name__ == "__main__":
    import time
    from mopup.session import get_spark
    from mopup.plans.catalog import QUERIES
    from mopup.plans.oracles import oracles
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN"):
        # the way a driver builds its session: none of the library's settings
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark("local[8]", 8)
    con = duck(sf)
    ors = oracles()
    names = sys.argv[1:] or list(QUERIES)
    bad = 0
    for n in names:
        if n not in ors:
            print(f"NO-ORACLE {n}")
            continue
        t = time.time()
        try:
            r = compare(spark, con, n, sf, QUERIES[n], ors[n])
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if r["ok"]:
            print(f"OK   {n:30s} rows={r['rows_spark']:6d} {time.time() - t:5.2f}s")
        else:
            bad += 1
            print(f"DIFF {n}: {r}")
    print("mismatches:", bad)
