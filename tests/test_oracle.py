"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list):
        return [plain(y) for y in x]
    return x


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, db, name):
    got = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    wrong = {c: (k, kinds[c]) for c, k in got.dtypes if k in KINDS and KINDS[k] != kinds[c]}
    order = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = {c: i for i, c in enumerate(want.columns)}
    b = sorted((tuple(plain(r[at[c]]) for c in order) for r in want.fetchall()), key=repr)
    assert a, "no rows"
    assert len(a) == len(b)
    assert not [(order, x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
    assert not wrong
