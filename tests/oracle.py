"""Run registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(entry, spark, con, folder):
    """None when equal, else a short description of the difference."""
    t = time.time()
    df = entry.run(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    mid = time.time()
    cur = con.execute(entry.sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    compare.times = (mid - t, time.time() - mid)
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; spark {left[1][:2]} duckdb {right[1][:2]}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{left[0]}\n      spark  {str(a)[:600]}\n      duckdb {str(b)[:600]}"
    return None if left[1] else "no rows"


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pagelens.plans.catalog import ENTRIES
    from pagelens.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for e in ENTRIES:
        if wanted and not any(w in e.name for w in wanted):
            continue
        t = time.time()
        try:
            if e.sql is None:
                n = e.run(spark, folder).count()
                result = None if n else "no rows"
            else:
                result = compare(e, spark, con, folder)
        except Exception as exc:
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {e.name} {time.time() - t:.1f}s {"spark %.1f duckdb %.1f" % getattr(compare, "times", (0, 0))} {'' if e.sql else '(rows only)'} {result or ''}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
