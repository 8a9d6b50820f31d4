"""Run queries and their SQL side by side: ``python -m checks.compare <folder> [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import SQL
from postpulse.plans.registry import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(repr(value))
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if name not in SQL:
        return f"ROWS  {name} {len(got)} ({spent:.1f}s)"
    start = time.time()
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    sql_spent = time.time() - start
    head = f"{name} {len(got)} rows ({spent:.1f}s, sql {sql_spent:.1f}s)"
    if sorted(names) != sorted(df.columns):
        return f"DIFF  {head} columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return f"MATCH {head}"
    only_got = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else []
    only_want = [r for r in want if r not in set(got)][:3] if len(got) < 50000 else []
    return f"DIFF  {head} vs {len(want)}\n   spark {str(only_got)[:900]}\n   sql   {str(only_want)[:900]}"


def main() -> None:
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            print(compare(spark, con, name, sf_dir), flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name} {type(error).__name__}: {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
