"""Every query against the checking engine, on the same tables."""
from collections import Counter

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def bag(rows):
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return Counter(tuple((k, tidy(r[k])) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", ORACLE)
def test_rows_equal(spark, con, name):
    got, want = bag(r.asDict() for r in QUERIES[name](spark, SF).collect()), bag(con.execute(ORACLE[name]).to_arrow_table().to_pylist())
    assert sum(want.values()) > 0
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
