"""Compare registered queries with their SQL twins: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value)
        return repr(value)

    return sorted(names), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    right = canonical(*oracle_rows(con, sql))
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    only_left = sorted(set(left[1]) - set(right[1]))[:2]
    only_right = sorted(set(right[1]) - set(left[1]))[:2]
    return f"rows {len(left[1])} / {len(right[1])}; spark {str(only_left)[:600]}; sql {str(only_right)[:600]}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            problem = difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} match; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
