"""Compare registered queries with their SQL: same columns, same rows. ``python tests/oracle.py [sf] [name...]`` prints a list."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows(columns: list[str], found: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in found)


def difference(spark, query, sql: str, folder: str, db: duckdb.DuckDBPyConnection) -> str | None:
    """What is different between the query's rows and those of the SQL; None if nothing is."""
    frame = query(spark, folder)
    a = rows(frame.columns, [tuple(r) for r in frame.collect()])
    answer = db.execute(sql)
    b = rows([c[0] for c in answer.description], answer.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        only_a, only_b = a[1] - b[1], b[1] - a[1]
        return f"{sum(a[1].values())} and {sum(b[1].values())} rows, {sum(only_a.values())} and {sum(only_b.values())} alone: {list(only_a)[:2]} and {list(only_b)[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sqls, db = entry.queries(), entry.oracle_sql(), engine(folder)
    for name in sys.argv[2:] or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            if name in sqls:
                found = difference(session, queries[name], sqls[name], folder, db) or "equal"
            else:
                found = f"{queries[name](session, folder).count()} rows, no SQL"
        except Exception as e:
            found = f"FAILED {type(e).__name__}: {str(e)[:700]}"
        print(f"{name} {time.time() - began:.1f}s {found}", flush=True)
