"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([norm(r[i]) for i in order]) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """Return (spark rows, error text or None)."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    for f in df.schema.fields:
        if f.dataType.typeName() in ("array", "map", "struct", "decimal"):
            return len(got), f"column {f.name} is {f.dataType.simpleString()}"
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(got), None
    miss = [x for x in a if x not in set(b)][:2]
    extra = [x for x in b if x not in set(a)][:2]
    return len(got), f"rows {len(a)} vs {len(b)}\n   spark only {miss}\n   sql only   {extra}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[0]
    only = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        mod = getattr(fn, '__module__', '').rsplit('.', 1)[-1]
        if only and not any(mod == o or name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as exc:
            n, err = -1, traceback.format_exc(limit=1)[-300:] + str(exc)[:1500]
        bad += err is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok ' if err is None else 'BAD'} {kind} {name:28s} {n:8d} {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
