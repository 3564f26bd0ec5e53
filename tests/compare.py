"""Run a registered query on Spark and its DuckDB oracle; compare rows."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

STRICT = os.environ.get("COMPARE_STRICT") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 5)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(_norm(v) for v in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None, show: int = 5):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir).toPandas()
    odf = con.execute(sql).fetchdf()
    scols, srows = _rows(sdf)
    ocols, orows = _rows(odf)
    problems = []
    if scols != ocols:
        problems.append(f"columns differ: spark-only={sorted(set(scols) - set(ocols))} "
                        f"oracle-only={sorted(set(ocols) - set(scols))}")
        return problems
    if len(srows) != len(orows):
        problems.append(f"row count spark={len(srows)} oracle={len(orows)}")
    oset = set(orows)
    sset = set(srows)
    diff_s = [r for r in srows if r not in oset]
    if diff_s:
        problems.append(f"{len(diff_s)} spark rows not in oracle")
        only_o = [r for r in orows if r not in sset]
        for a, b in list(zip(diff_s, only_o))[:show]:
            d = {c: (x, y) for c, x, y in zip(scols, a, b) if x != y}
            problems.append(f"  diff: {d}")
    return problems


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from churnlens.session import get_spark
    spark = get_spark("local[8]", 8)
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        if name not in os_:
            print(f"{name}: (no oracle)")
            continue
        try:
            probs = compare(spark, name, qs[name], os_[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            probs = [f"error: {type(e).__name__}: {str(e)[:1500]}"]
        print(f"{name}: {'OK' if not probs else 'FAIL'}")
        for p in probs:
            print("   ", p)
        bad += bool(probs)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("--sf=")]
    sf = next((a[5:] for a in sys.argv[1:] if a.startswith("--sf=")), "/root/testdata/sf0.01")
    sys.exit(1 if main(args or None, sf) else 0)
