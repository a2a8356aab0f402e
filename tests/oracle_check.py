"""Compare every registered Spark query with its DuckDB SQL.

Usage: ``python tests/oracle_check.py [sf_dir] [name-substring ...]``.
Prints one line per query: rows, column and value agreement.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    normed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return cols, hashlib.sha256("\n".join(normed).encode()).hexdigest()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as entry
    from relaywatch.plans import catalog

    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = {}
    own = set(catalog.spark_queries())   # the training-data queries are checked in tests/llm
    for name, fn in qs.items():
        if not any(n in name for n in names) if names else name not in own:
            continue
        df = fn(spark, sf_dir)
        s_rows = [tuple(r) for r in df.collect()]
        s_cols, s_hash = digest(df.columns, s_rows)
        if name not in sqls:
            out[name] = {"rows": len(s_rows), "oracle": None}
            if verbose:
                print(f"{name:32s} rows={len(s_rows)} (no oracle)")
            continue
        res = con.execute(sqls[name])
        o_cols_raw = [d[0] for d in res.description]
        o_rows = res.fetchall()
        o_cols, o_hash = digest(o_cols_raw, o_rows)
        ok = (len(s_rows) == len(o_rows), s_cols == o_cols, s_hash == o_hash)
        out[name] = {"rows": len(s_rows), "oracle_rows": len(o_rows), "cols": ok[1], "values": ok[2]}
        if verbose:
            flag = "OK " if all(ok) else "BAD"
            print(f"{flag} {name:32s} rows={len(s_rows)}/{len(o_rows)} cols={ok[1]} values={ok[2]}")
            if not ok[1]:
                print("   spark :", s_cols)
                print("   oracle:", o_cols)
            elif not ok[2]:
                order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
                sn = sorted(tuple(_norm(r[i]) for i in order) for r in s_rows)
                on = sorted(tuple(_norm(r[o_cols_raw.index(df.columns[i])]) for i in order) for r in o_rows)
                for a, b in zip(sn, on):
                    if a != b:
                        print("   spark :", dict(zip(s_cols, a)))
                        print("   oracle:", dict(zip(o_cols, b)))
                        break
    return out


if __name__ == "__main__":
    from relaywatch.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("oracle") is not None or "values" in v
           if not (v.get("cols", True) and v.get("values", True) and v.get("rows") == v.get("oracle_rows", v.get("rows")))]
    print(f"{len(res) - len(bad)}/{len(res)} agree")
