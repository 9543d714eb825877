"""Compare registered queries with their SQL: ``python tests/run_oracle.py [sf] [name-prefix ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import differences, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from strandmill.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    con, bad = duck(sf_dir), 0
    for name, query in queries.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = differences(spark, query, sqls[name], sf_dir, con)
            else:
                n = len(query(spark, sf_dir).collect())
                diff = "" if n else "EMPTY"
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {time.time() - start:6.2f}s {name} "
              f"{'' if name in sqls else '(rows only)'} {diff}", flush=True)
    print(f"{len(queries)} queries, {len(sqls)} with SQL, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
