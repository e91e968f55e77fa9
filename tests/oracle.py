"""Compares a query with its SQL run by DuckDB on the same tables, and times both; also a command."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([cell(v[i]) for i in order]) for v in values))


def compare(spark, name, query, sql, sf="sf0.01"):
    """None if both give the same rows, else what differs."""
    df = query(spark, f"{DATA}/{sf}")
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"{name}: columns {df.columns} and {rel.columns}"
    theirs = rows(rel.columns, rel.fetchall())
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{name}: {len(ours)} and {len(theirs)} rows; only ours: {sorted(a)[:3]}; only SQL's: {sorted(b)[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    wanted = [q for q in queries if not sys.argv[1:] or any(q.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for q in wanted:
        t = time.time()
        try:
            if q in sqls:
                said = compare(spark, q, queries[q], sqls[q]) or "same"
            else:
                df = queries[q](spark, f"{DATA}/sf0.01")
                r = df.collect()
                said = f"no SQL; {len(r)} rows, first {str(r[:2])[:300]}"
        except Exception as x:  # a report over all queries
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        bad += not said.startswith(("same", "no SQL"))
        print(f"{q} ({time.time() - t:.1f} s): {said}", flush=True)
    print("different:", bad)
