"""Run registered queries next to their SQL and compare: check_oracle.py SF_DIR [name …]."""

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    """(rows, seconds in Spark, seconds in SQL, difference or None)"""
    start = time.time()
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(rows), spent, 0.0, None
    start = time.time()
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    types = {c[0]: str(c[1]) for c in found.description}
    expected = found.fetchall()
    took = time.time() - start
    a, b = table(df.columns, rows), table(columns, expected)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [(c, t, types.get(c)) for c, t in df.dtypes if names.get(t) != types.get(c)]
    if a[0] != b[0]:
        return len(rows), spent, took, f"columns {a[0]} {b[0]}"
    if len(rows) != len(expected):
        return len(rows), spent, took, f"rows {len(rows)} {len(expected)}"
    different = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if different:
        return len(rows), spent, took, f"{len(different)} rows differ, first {different[0]}"
    return len(rows), spent, took, f"types {wrong}" if wrong else None


def main():
    sf, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        try:
            rows, spent, took, difference = compare(spark, con, name, sf)
        except Exception as error:
            rows, spent, took, difference = -1, 0, 0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += difference is not None
        print(f"{'ok ' if difference is None else 'BAD'} {name} rows={rows} spark={spent:.1f}s "
              f"sql={took:.1f}s {difference or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
