"""Compare a Spark query with its SQL oracle run by DuckDB on the same parquet files.

Row count, column names and an order-insensitive hash of the values are compared.
Doubles are compared after rounding to 6 digits; integral doubles compare equal to
integers (toPandas turns nullable integer columns into floats).
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

from ..model import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _canon(v) -> str:
    if v is None or v is getattr(__import__("pandas"), "NA", None) or type(v).__name__ in ("NAType", "NaTType"):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer() and abs(v) < 1e15:
            return str(int(v))
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _canon(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, int):
        return str(v)
    return str(v)


def fingerprint(pdf) -> tuple[list[str], int, str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append("\x1f".join(_canon(x) for x in rec))
    rows.sort()
    h = hashlib.sha256("\x1e".join(rows).encode()).hexdigest()
    return cols, len(rows), h


def compare(spark, name: str, sf_dir: str, con=None, show_diff: bool = True) -> dict:
    from .catalog import oracle_sql, queries

    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    spdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    out = {"name": name, "spark_rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duckdb_connection(sf_dir)
    ddf = con.execute(sql).fetchdf()
    out["oracle_rows"] = len(ddf)
    sc, sn, sh = fingerprint(spdf)
    dc, dn, dh = fingerprint(ddf)
    ok = sc == dc and sn == dn and sh == dh
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        out["spark_cols"], out["oracle_cols"] = sc, dc
        if show_diff and sc == dc:
            a = {"\x1f".join(_canon(x) for x in r) for r in spdf[sc].itertuples(index=False, name=None)}
            b = {"\x1f".join(_canon(x) for x in r) for r in ddf[dc].itertuples(index=False, name=None)}
            out["only_spark"] = sorted(a - b)[:3]
            out["only_oracle"] = sorted(b - a)[:3]
    return out


def main(argv: list[str]) -> int:
    from ..session import build_session
    from .catalog import queries

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = build_session("local[8]", 8)
    con = duckdb_connection(sf_dir)
    names = names or sorted(queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": repr(e)[:600]}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
