"""Command line: compare all (or the named) queries, print one line each.

    python tests/run_oracle.py [sf] [name ...]
"""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from uttermark.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    root = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        try:
            if name in oracles:
                result = compare(spark, con, queries[name], oracles[name], root)
                s, d, n = compare.timing
                print(f"{'ok  ' if result is None else 'DIFF'} {name} spark={s:.2f}s sql={d:.2f}s "
                      f"rows={n} {result or ''}"[:600], flush=True)
                bad += result is not None
            else:
                print(f"rows {name} {queries[name](spark, root).count()}", flush=True)
        except Exception as e:
            bad += 1
            print("FAIL", name, str(e)[:1500], flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)
