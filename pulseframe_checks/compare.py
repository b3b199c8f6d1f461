"""Run registered queries against their DuckDB oracles and report differences.

    python -m pulseframe_checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    same = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",),
            "date": ("DATE",), "timestamp_ntz": ("TIMESTAMP",), "boolean": ("BOOLEAN",)}
    for f in df.schema.fields:
        if kinds[f.name] not in same.get(f.dataType.simpleString(), ()):
            return f"type of {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return (f"rows {len(got)} vs {len(want)}; {sorted(df.columns)}; only spark {sorted(extra)[:2]}; "
                f"only oracle {sorted(missing)[:2]}; {len(extra)} differ")
    return None if got else "no rows"


def main(argv):
    from pyspark.sql import SparkSession

    from pulseframe_checks.oracle import ORACLE
    from pulseframe_checks.registry import QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf_dir), 0
    for name in wanted:
        t = time.time()
        try:
            diff = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:400]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t:.1f}s {'' if name in ORACLE else '(no oracle) '}{diff or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
