"""Run registered queries beside their SQL twins and compare them.

    python tests/oracle_check.py [sf_dir] [key prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(con, spark, sf_dir: str, fn, sql: str | None) -> str:
    """Empty text when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if not want:
        return "the SQL twin has no rows"
    if a != b:
        more, less = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(got)} vs {len(want)} rows ({sum((a - b).values())} differ); {sorted(cols)} spark {more} sql {less}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from tollspan.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf_dir), entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if args and not any(key.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            why = compare(con, spark, sf_dir, fn, oracle.get(key))
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {time.time() - t:6.2f}s {'sql ' if key in oracle else 'rows'} {key} {why}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
