"""Compare registered queries with their SQL in DuckDB: names, row counts, values."""

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = _sorted([tuple(r) for r in df.collect()], got_cols)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _sorted(cur.fetchall(), cols)
    if sorted(got_cols) != sorted(cols):
        return f"columns {sorted(got_cols)} != {sorted(cols)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; extra {list(a - b)[:2]} missing {list(b - a)[:2]}"
    if len(got) == 0:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    types = {type(x) for r in got[:1] for x in r} ^ {type(x) for r in want[:1] for x in r}
    return f"types {types}" if types - {type(None)} else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession
    from tickweave.catalogue import QUERIES, SQL

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in SQL:
                problem = compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
            else:
                problem = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t:.1f}s "
              f"{'' if name in SQL else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
