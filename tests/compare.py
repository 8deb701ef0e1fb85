"""Run queries in Spark and their SQL twins in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("convolytics-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((_cell(r[i]), type(r[i]).__name__) for i in order) for r in rows)


def difference(spark, con, folder, name, query, sql) -> str:
    """'' when both give the same rows, else what differs."""
    df = query(spark, folder)
    got = df.collect()
    if sql is None:
        return "" if got else "no rows"
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if a == b:
        return "" if got else "no rows on either side"
    more, less = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{len(got)} rows, oracle {len(want)}\n   spark only {more}\n   oracle only {less}"


def main() -> int:
    from convolytics.catalog import ORACLES, QUERIES

    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = difference(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok '} {time.time() - start:6.2f}s {name} {diff}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
