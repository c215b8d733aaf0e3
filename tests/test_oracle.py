"""Every registered query gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerline import registry
from ledgerline.plans.dialect import TABLES


@pytest.fixture(scope="module")
def engine(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.everything()))
def test_rows_of_the_oracle(spark, sf_dir, engine, name):
    q = registry.everything()[name]
    frame = q.run(spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.select(*columns).toArrow().to_pylist())
    if q.oracle:
        found = engine.sql(q.oracle)
        assert sorted(found.columns) == columns
        assert got == sorted(str(r) for r in found.select(*columns).fetchall())
