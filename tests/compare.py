"""Runs queries and their SQL side by side: python tests/compare.py [sf_dir] [name ...]"""

import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    return round(x, 6) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


def differs(spark, con, sf_dir, query, sql):
    df, want = query(spark, sf_dir), con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {df.columns} {want.columns}"
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; " + "; ".join(f"{x} != {y}" for x, y in list(zip(a, b)) if x != y)[:600]
    return None


if __name__ == "__main__":
    os.environ["PYTHONPATH"] = str(ROOT)
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, q, sql = connect(d), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            said = differs(s, con, d, q[name], sql[name]) if name in sql else f"{q[name](s, d).count()} rows, no SQL"
        except Exception as x:
            said = f"FAILED {str(x)[:700]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
