"""Registered queries against their SQL on DuckDB, over the smallest tables."""

import math
import os

import pytest

from trustlake import catalog

DATA = "/root/testdata/sf0.001"
#: These build a lake day by day; the driver holds them against SQL over larger tables.
SLOW = ("lake_", "gate_partitions", "gate_fresh", "gate_min", "gate_refusal", "gated_", "graph_published")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if not n.startswith(SLOW) or n in ("lake_replay", "lake_refusals")))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
