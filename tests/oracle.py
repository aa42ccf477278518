"""Runs registered queries against their DuckDB twins: python tests/oracle.py SF [NAME...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, bool):
            return ("b", x)
        if isinstance(x, float):
            return ("n", None if math.isnan(x) else round(x, 6))
        if isinstance(x, int):
            return ("n", x)
        if isinstance(x, (list, tuple)):
            return ("l", tuple(cell(y) for y in x))
        return ("s", None if x is None else str(x))

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql, sf):
    df = f(spark, sf)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canon(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names), f"columns {sorted(df.columns)} against {sorted(names)}"
    assert len(got) == len(want), f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        assert a == b, f"{a} against {b}"
    return len(got)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}{'/*' if os.path.isdir(f'{sf}/{f}') else ''}')")
    return con


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", "/tmp/codeloom-warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf = f"/root/testdata/{sys.argv[1]}"
    con, bad = connect(sf), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            note = compare(spark, con, queries[name], oracles[name], sf) if name in oracles else f"{queries[name](spark, sf).count()} (no oracle)"
            print(f"{name}: {note} rows, {time.time() - t:.1f} s", flush=True)
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {str(e)[:700]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
