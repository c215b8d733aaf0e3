"""Queries over returns give the rows of their SQL where a user's wealth is nothing on the first days."""

import os

import duckdb
import pytest

from ledgerline import registry
from ledgerline.plans.dialect import TABLES

NAMES = [
    "b05_01_twr", "b05_04_period_returns", "b05_06_composite", "b05_08_return_to_book", "b05_09_blended_benchmark", "b05_12_factor_regression", "b06_01_tracking_error",
    "b06_02_alpha_beta", "b06_03_appraisal", "b06_03_sharpe", "b06_04_sortino", "b06_05_drawdown", "b06_06_capture", "b06_06_linked_capture", "b06_07_alpha_t", "b06_07_skill",
    "b09_01_var_es", "b09_02_parametric_var", "b09_04_kupiec", "b09_04_var_backtest", "b09_06_desmoothing", "b09_07_risk_contribution", "b14_07_risk_budget", "b17_07_ex_ante",
]
PLANTED = [(7001, 2, 0.0), (7001, 4, 5.0), (7001, 5, 2.0), (7001, 20, 3.0), (7002, 3, 0.0), (7002, 4, 0.0), (7002, 9, 1.0)]


@pytest.fixture(scope="module", params=[4, 7])
def planted(request, sf_dir, tmp_path_factory):
    """Tables with a user whose return is infinite, and then one whose is not a number as well."""
    folder = tmp_path_factory.mktemp("zero")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    rows = ", ".join(f"({900_000 + k}::bigint, timestamp '2024-01-{day:02d} 01:00:00', {user}::bigint, 'view', {value}::double, '{{}}')" for k, (user, day, value) in enumerate(PLANTED[: request.param]))
    duckdb.sql(f"copy (select * from '{sf_dir}/events.parquet' union all by name select * from (values {rows}) as x(event_id, ts, user_id, event_type, value, props)) to '{folder}/events.parquet' (format parquet)")
    engine = duckdb.connect()
    engine.sql("set timezone = 'UTC'")
    for t in TABLES:
        engine.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), engine


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_the_oracle_with_days_of_nothing(spark, planted, name):
    folder, engine = planted
    q = registry.everything()[name]
    frame = q.run(spark, folder)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.select(*columns).toArrow().to_pylist())
    assert got == sorted(str(r) for r in engine.sql(q.oracle).select(*columns).fetchall())
