"""Run every registry key in Spark and DuckDB and print the comparison.

Usage: python tests/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402

from stationflow.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            pdf = fn(spark, sf).toPandas()
        except Exception as exc:  # report and continue
            print(f"{name:28s} SPARK-ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        dt = time.time() - t
        if name not in sqls:
            print(f"{name:28s} rows-only {len(pdf)} rows  {dt:.2f}s")
            continue
        try:
            ddf = duck(sqls[name], sf)
        except Exception as exc:
            print(f"{name:28s} DUCK-ERROR {str(exc)[:300]}")
            bad += 1
            continue
        ok, msg = compare(pdf, ddf)
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} {len(pdf)} rows  {dt:.2f}s  {'' if ok else msg}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
