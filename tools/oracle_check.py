"""Run registered queries on Spark and their DuckDB oracles side by side.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: status, rows, and the first difference found.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from docsift.plans.registry import registry  # noqa: E402
from docsift.session import get_spark  # noqa: E402
from docsift.sources.tables import TABLES, table_path  # noqa: E402


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append("|".join(canon(x) for x in rec))
    return cols, sorted(out)


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    reg = registry()
    names = [n for n in reg if not args or any(a in n for a in args)]
    bad = 0
    for name in names:
        spec = reg[name]
        t0 = time.time()
        try:
            sdf = spec.build(spark, sf_dir)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-ERR {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if spec.oracle is None:
            print(f"ROWS-ONLY {name}: rows={len(sp)} {ts:.1f}s")
            continue
        try:
            rel = con.sql(spec.oracle)
            ob = rel.df()
        except Exception as e:  # noqa: BLE001
            print(f"ORACLE-ERR {name}: {str(e)[:400]}")
            bad += 1
            continue
        st = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
        ot = dict(zip(rel.columns, [str(t) for t in rel.types]))
        if st != ot:
            print(f"TYPES {name}: spark={st} oracle={ot}")
            bad += 1
            continue
        sc, sr = rows_of(sp)
        oc, orows = rows_of(ob)
        if sc != oc:
            print(f"COLS {name}: spark={sc} oracle={oc}")
            bad += 1
            continue
        if len(sr) != len(orows):
            print(f"ROWCOUNT {name}: spark={len(sr)} oracle={len(orows)}")
            bad += 1
            continue
        hs = hashlib.md5("\n".join(sr).encode()).hexdigest()
        ho = hashlib.md5("\n".join(orows).encode()).hexdigest()
        dt = [f"{c}:{sp[c].dtype}/{ob[c].dtype}" for c in sc if str(sp[c].dtype) != str(ob[c].dtype)]
        if hs != ho:
            diff = [(a, b) for a, b in zip(sr, orows) if a != b][:2]
            print(f"VALUES {name}: rows={len(sr)} first diffs: {diff} dtypes:{dt}"[:1500])
            bad += 1
        else:
            print(f"OK {name}: rows={len(sr)} {ts:.1f}s {('dtypes:' + ','.join(dt)) if dt else ''}")
    print(f"done: {len(names)} queries, {bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
