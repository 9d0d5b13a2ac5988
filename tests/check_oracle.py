"""Run every registered query at one scale factor and compare it with its SQL twin.

    python -m tests.check_oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, build, sql):
    """None when equal, otherwise a short description of the first difference."""
    return compare_df(build(spark, sf_dir), con, sql)


def compare_df(df, con, sql):
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want_names, want = table(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(argv):
    from shelfweave.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        begun = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, build, sqls.get(name))
        except Exception as error:  # report every query, not only the first broken one
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "S" if name in sqls else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - begun:6.2f}s {name} {problem or ''}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
