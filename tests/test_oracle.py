import os

import duckdb
import pytest
from conftest import SMALL

from resampla import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, SMALL).toPandas(), con.sql(catalog.ORACLE[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    tidy = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values.tolist()))
    assert tidy(ours) == tidy(theirs)
