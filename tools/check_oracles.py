"""Run registered queries and compare them with their SQL: check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    """None if they agree, else what differs."""
    df = run(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        left, right = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return (f"{len(got[1])} vs {len(want[1])} rows; {len(left)} / {len(right)} differ\n"
                f"  spark  {[x for x in sorted(left)[:2]]}\n  duckdb {[x for x in sorted(right)[:2]]}")[:1500]
    return None


def main():
    from pyspark.sql import SparkSession

    from catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or n.startswith(w) for w in names)]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {name} {time.time() - start:.1f}s", flush=True)
        if problem is not None:
            bad.append(name)
            print("     " + problem, flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; bad: {bad}")


if __name__ == "__main__":
    main()
