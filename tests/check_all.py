"""python tests/check_all.py [sf_dir] [query ...]: compare queries with their SQL and time them."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from millrace.session import build_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            found = difference(run(spark, sf_dir), con, sqls[name]) if name in sqls else "no SQL"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{time.perf_counter() - start:6.2f}s {name:24s} {'ok' if found is None else found}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, sys.argv[2:]) else 0)
