"""Run registered queries against their SQL twins: python tests/check_oracle.py [names ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import connect, difference  # noqa: E402
from tideline.catalogue import all_oracles, all_queries  # noqa: E402
from tideline.session import local_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT"):  # rows of a slice
        spark.conf.set("tideline.slice.rows", os.environ["HOT"])
    con = connect(sf)
    queries, oracles = all_queries(), all_oracles()
    names = [n for n in queries if not sys.argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[1:])]
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = difference(df, con, oracles[name])
                note = "ok" if diff is None else f"DIFF {diff}"
                n = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0] if diff is None else -1
                note += f" rows={n}"
            else:
                note = f"no-sql rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            note = "FAIL " + str(e)[:600].replace("\n", " ")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
