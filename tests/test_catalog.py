import math
import os

import duckdb
import pytest

from trajectorium import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda x: round(x, 4) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(clean(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    c = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, c.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
