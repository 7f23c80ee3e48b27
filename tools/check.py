"""Compare catalog queries with their DuckDB statements: check.py SF_DIR [name ...]."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "as_integer_ratio"):
        return str(int(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, query, sql):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return f"{name:26s} rows {len(got):7d} {took:6.1f}s (no SQL)", True
    t1 = time.time()
    cur = con.cursor()
    cur.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    sql_took = time.time() - t1
    if sorted(df.columns) != sorted(names):
        return f"{name:26s} COLUMNS {sorted(df.columns)} != {sorted(names)}", False
    ok = got == want
    text = f"{name:26s} rows {len(got):7d} {took:6.1f}s sql {sql_took:5.1f}s {'ok' if ok else 'DIFFERENT'}"
    if not ok:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        text += f"\n   {len(got)} vs {len(want)}\n   spark {a}\n   sql   {b}"
    return text, ok


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from emberwatch.plans.catalog import QUERIES
    from emberwatch.plans.expected_sql import EXPECTED

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, con, bad = sys.argv[1], connect(sys.argv[1]), []
    for name in sys.argv[2:] or QUERIES:
        try:
            line, ok = compare(spark, con, name, sf_dir, QUERIES[name], EXPECTED.get(name))
        except Exception as e:
            line, ok = f"{name:26s} ERROR {type(e).__name__} {str(e)[:1500]}", False
        print(line, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
