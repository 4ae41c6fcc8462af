"""Every query that has SQL gives the SQL's rows."""

import math

import pytest

from tessera import plans


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return str(v)
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir)
    rows = got.collect()
    assert rows, "no rows"
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    mine = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in rows)
    theirs = sorted(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())
    assert mine == theirs
