"""Run registered queries beside their SQL twins and compare the rows.

``python tests/check_twins.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(value):
    """Values of both engines in one form."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(directory):
    import duckdb
    from fitgrid.schemas import RAW_TABLES
    con = duckdb.connect()
    for table in RAW_TABLES:
        con.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return con


def check(spark, con, name, build, sql, directory):
    started = time.time()
    df = build(spark, directory)
    got = rows_of(df.columns, df.collect())
    spark_s = time.time() - started
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} in {spark_s:.1f}s"
    started = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    note = f"{len(got)} rows in {spark_s:.1f}s (twin {time.time() - started:.1f}s)"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{note}; twin has {len(want)} rows\n  only here: {sorted(a - b, key=repr)[:3]}"
                       f"\n  only twin: {sorted(b - a, key=repr)[:3]}")
    return len(got) > 0, note


def main():
    from fitgrid.plans.catalog import all_queries, all_twins
    from fitgrid.session import local_session
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark, con = local_session(), oracle(directory)
    queries, twins = all_queries(), all_twins()
    bad = 0
    for name in names:
        try:
            ok, note = check(spark, con, name, queries[name], twins.get(name), directory)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
