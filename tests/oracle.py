"""Runs queries beside their SQL and compares rows: python tests/oracle.py [--sf DIR] [NAME...]."""

import datetime
import decimal
import math
import os
import sys
import time

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [names[i] for i in order]


def compare(spark, con, query, sql, sf):
    df = query(spark, sf)
    got, names = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(got), ""
    res = con.execute(sql)
    want, theirs = rows_of([d[0] for d in res.description], res.fetchall())
    if names != theirs:
        return False, len(got), f"columns {names} and {theirs}"
    if got == want:
        return True, len(got), ""
    only = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return False, len(got), f"{len(got)} and {len(want)} rows; only here {only[0]}; only in SQL {only[1]}"


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args and name not in args or not args and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            ok, n, why = compare(spark, con, query, sqls.get(name), sf)
        except Exception as e:
            ok, n, why = False, 0, str(e)[:600]
        bad += ok is False
        print(f"{'rows only' if ok is None else 'ok' if ok else 'DIFFERS'} {name} {n} rows {time.time() - began:.1f} s {why}", flush=True)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
