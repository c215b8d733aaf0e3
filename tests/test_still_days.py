"""Queries over returns give the rows of their SQL where users' wealth, and with it the market, stands still."""

import os

import duckdb
import pytest

from ledgerline import registry
from ledgerline.plans.dialect import TABLES

NAMES = ["b06_06_linked_capture", "b09_06_desmoothing", "b05_12_factor_regression", "b06_03_appraisal", "b06_07_alpha_t", "b17_16_rank_ic", "b17_16_signal_decay"]


@pytest.fixture(scope="module", params=["true", "e.user_id in (5, 8)"])
def still(request, sf_dir, tmp_path_factory):
    """Tables where all users, and then two of them, have values of nothing after their first day."""
    folder = tmp_path_factory.mktemp("still")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    events = f"{sf_dir}/events.parquet"
    first = f"select min(cast(ts as date)) from '{events}'" + (" where user_id = e.user_id" if request.param != "true" else "")
    duckdb.sql(f"copy (select * replace (case when {request.param} and cast(ts as date) > ({first}) then 0.0 else value end as value) from '{events}' as e) to '{folder}/events.parquet' (format parquet)")
    engine = duckdb.connect()
    engine.sql("set timezone = 'UTC'")
    for t in TABLES:
        engine.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), engine


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_the_oracle_where_wealth_stands_still(spark, still, name):
    folder, engine = still
    q = registry.everything()[name]
    frame = q.run(spark, folder)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.select(*columns).toArrow().to_pylist())
    assert got == sorted(str(r) for r in engine.sql(q.oracle).select(*columns).fetchall())
