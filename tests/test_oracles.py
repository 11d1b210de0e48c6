"""Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this at sf0.01): same columns, same row multiset."""

import math

import pandas as pd
import pytest

from conftest import SF_SMALL
from docsift.plans.registry import registry

REG = registry()
WITH_ORACLE = sorted(n for n, s in REG.items() if s.oracle)
ROWS_ONLY = sorted(n for n, s in REG.items() if not s.oracle)


def _canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return str(int(v)) if v.is_integer() and abs(v) < 2**53 else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


# Spark type -> DuckDB type of the same values.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, duck, name):
    spec = REG[name]
    df = spec.build(spark, SF_SMALL)
    rel = duck.sql(spec.oracle)
    spark_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert spark_types == duck_types
    got = df.toPandas()
    want = rel.df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    df = REG[name].build(spark, SF_SMALL)
    assert df.count() >= 0
