"""Run registered queries against their SQL and report: python tests/compare_run.py SF_DIR [prefix...]"""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import duckdb  # noqa: E402
from compare import assert_same  # noqa: E402
from panelweave.plans import all_oracles, all_queries  # noqa: E402
from panelweave.session import local_session  # noqa: E402

SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
        "boolean": "BOOLEAN"}

if __name__ == "__main__":
    sf = sys.argv[1]
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    spark = local_session(8)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for key, fn in queries.items():
        if len(sys.argv) > 2 and not any(key.startswith(p) for p in sys.argv[2:]):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            data = [tuple(r) for r in df.collect()]
            took, note = time.time() - t0, "rows only"
            if key in oracles:
                t1 = time.time()
                cur = con.execute(oracles[key])
                res = cur.fetchall()
                exact, n = assert_same(df.columns, data, [c[0] for c in cur.description], res)
                note = f"{'EXACT' if exact == n else f'close {exact}/{n}'} sql {time.time() - t1:.1f}s"
                types = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {oracles[key]})").fetchall())
                for f in df.schema.fields:
                    s, d = f.dataType.simpleString(), types[f.name]
                    if SAME.get(s, s) != d:
                        note += f" TYPE {f.name}:{s}/{d}"
            print(f"{key:32s} {took:6.2f}s rows={len(data):6d} {note}", flush=True)
        except Exception as err:  # report and go on
            bad += 1
            print(f"{key:32s} FAILED {type(err).__name__}: {str(err)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", bad)
