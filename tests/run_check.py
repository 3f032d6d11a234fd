"""python tests/run_check.py SF [name-prefix…]: compare queries with their SQL, with times."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import difference, oracle, type_names  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ashlar.session import local_session  # noqa: E402

sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session("8")
con = oracle(sf_dir)
sql = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in sql:
            report, n = difference(df, con, sql[name])
            types = type_names(df, con, sql[name])
            t1 = time.time()
            con.execute(sql[name]).fetchall()
            dt = time.time() - t1
            ok = report is None and not types
            bad += not ok
            print(f"{'ok ' if ok else 'BAD'} {name} rows={n} {t1 - t0:.2f}s sql={dt:.2f}s {report or ''} {types or ''}", flush=True)
        else:
            print(f"--- {name} rows={df.count()} {time.time() - t0:.2f}s", flush=True)
    except Exception as e:  # report and go on
        bad += 1
        print(f"ERR {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
print("bad:", bad)
