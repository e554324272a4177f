"""Compare registered queries with their SQL: ``run_oracles.py [folder] [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402
from mediaquarry.session import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if len(sys.argv) < 3 or any(p in n for p in sys.argv[2:])]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                found = differences(queries[name](spark, folder), con, oracles[name])
                note = "ok" if not found else "; ".join(found)
            else:
                found, note = [], f"rows only: {queries[name](spark, folder).count()}"
        except Exception as problem:  # noqa: BLE001
            found = [problem]
            note = f"{type(problem).__name__}: {str(problem)[:900]}"
        bad += bool(found)
        print(f"{'BAD' if found else 'OK '} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
