"""Runs registered queries next to their SQL and reports differences.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pluvia")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"),
                  round(v, 3) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in rows]


def compare(spark_cols, spark_rows, sql_cols, sql_rows) -> str | None:
    a_cols, a = rows_of(spark_cols, spark_rows)
    b_cols, b = rows_of(sql_cols, sql_rows)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = sorted(a, key=sort_key), sorted(b, key=sort_key)
    exact = sorted(map(repr_row, a)) == sorted(map(repr_row, b))
    if exact:
        return None
    bad = [(x, y) for x, y in zip(a, b) if repr_row(x) != repr_row(y)]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]}"


def repr_row(row):
    return tuple(
        repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in row
    )


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    from pluvia.plans.catalog import ORACLES, QUERIES

    spark, sf_dir = session(), f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    names = argv or list(QUERIES)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = df.collect()
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                cur = con.execute(ORACLES[name])
                cols = [d[0] for d in cur.description]
                want = cur.fetchall()
                message = compare(df.columns, got, cols, want)
                status = "ok" if message is None else f"DIFF {message}"
                sql_time = f"{time.time() - start:5.1f}s sql"
            else:
                status, sql_time = ("rows-only" if got else "EMPTY"), " " * 10
        except Exception as e:  # report and go on
            took, sql_time = time.time() - start, " " * 10
            status = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if not (status == "ok" or status == "rows-only"):
            failed.append(name)
        print(f"{name:32s} {took:6.1f}s {sql_time} {status}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
