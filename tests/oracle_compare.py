"""Run registered queries on Spark and their SQL oracles on DuckDB; compare
row count, column names and an order-insensitive hash of the values.

CLI:  python -m tests.oracle_compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time(0) else v.isoformat()
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return repr(int(v))
        return repr(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _norm(v.item())
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(int(v))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def frame_hash(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted(repr([_norm(r[c]) for c in cols]) for r in pdf.to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    from __spark_entry__ import oracle_sql, queries

    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"spark: {e}"[:500]}
            if verbose:
                print(name, "SPARK ERROR", str(e)[:500], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            out[name] = {"ok": None, "rows": len(sdf), "spark_s": round(ts, 2)}
            if verbose:
                print(f"{name}: rows-only {len(sdf)} ({ts:.1f}s)", flush=True)
            continue
        try:
            ddf = con.execute(sqls[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"duckdb: {e}"[:500]}
            if verbose:
                print(name, "DUCKDB ERROR", str(e)[:500], flush=True)
            continue
        a, b = frame_hash(sdf), frame_hash(ddf)
        ok = a == b
        out[name] = {"ok": ok, "rows": (a[0], b[0]), "spark_s": round(ts, 2)}
        if verbose:
            print(f"{name}: {'OK' if ok else 'MISMATCH'} rows {a[0]}/{b[0]} ({ts:.1f}s)", flush=True)
            if not ok:
                if a[1] != b[1]:
                    print("  cols spark", a[1], "\n  cols duck ", b[1])
                else:
                    sa = sdf[a[1]].sort_values(a[1]).reset_index(drop=True)
                    sb = ddf[b[1]].sort_values(b[1]).reset_index(drop=True)
                    print("  spark head:\n", sa.head(5).to_string()[:1500])
                    print("  duck head:\n", sb.head(5).to_string()[:1500])
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from tillroll.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
