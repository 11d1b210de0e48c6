"""Oracle check under other session settings, e.g.
python tools/session_check.py spark.sql.session.timeZone=America/New_York
python tools/session_check.py spark.sql.ansi.enabled=false
Prints the queries whose result differs from the oracle."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb  # noqa: E402

from docsift.plans.registry import registry  # noqa: E402
from docsift.session import get_spark  # noqa: E402
from docsift.sources.tables import TABLES, table_path  # noqa: E402
from oracle_check import rows_of  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[4]")
    for kv in sys.argv[1:]:
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    bad = []
    for name, spec in sorted(registry().items()):
        if not spec.oracle:
            continue
        try:
            if rows_of(spec.build(spark, sf).toPandas()) != rows_of(con.sql(spec.oracle).df()):
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            bad.append(f"{name}: {str(e)[:120]}")
    print("differences:", bad)
