"""Commitments are projected for as many portfolios as there are, past Spark's limit of a recursion's rows."""

import duckdb
import pytest

from ledgerline import registry
from ledgerline.operators.funds import projection

NAME = "b07_07_projection"
#: Prices of orders by portfolio: whole cents, less than four, nothing, less than nothing, orders that cancel out, none known.
PLANTED = [(1, 0.01), (2, 0.03), (3, 0.05), (4, 0.0), (5, -7.0), (6, 9.5), (6, -9.5), (7, None), (7, 1.23), (8, None), (None, 4.56)]


def engine(folder, prices):
    """An engine over a table of the orders that ``prices`` selects as portfolio and price."""
    own = duckdb.connect()
    own.sql(f"copy (select row_number() over () as o_orderkey, cast(p as bigint) as o_custkey, 'O' as o_orderstatus, cast(t as double) as o_totalprice, timestamp '1998-01-01' as o_orderdate, '1-URGENT' as o_orderpriority from ({prices}) as x(p, t)) to '{folder}/orders.parquet' (format parquet)")
    own.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    return own


def same_rows(spark, folder, own):
    """How many rows both gave, and how many only one of them did."""
    q = registry.everything()[NAME]
    q.run(spark, str(folder)).write.parquet(f"{folder}/found")
    own.sql(f"create table expected as {q.oracle}")
    own.sql(f"create view found as select * from '{folder}/found/*.parquet'")
    only = "select count(*) from (select portfolio_id, age, called, nav from {} except all select portfolio_id, age, called, nav from {})"
    return own.sql("select count(*) from found").fetchall()[0][0], own.sql(only.format("found", "expected")).fetchall()[0][0] + own.sql(only.format("expected", "found")).fetchall()[0][0]


def test_more_rows_than_a_recursion_may_have(spark, tmp_path):
    own = engine(tmp_path, "select k, k * 0.37 from range(1, 130001) as r(k)")
    assert same_rows(spark, tmp_path, own) == (8 * 130_000, 0)


def test_odd_commitments(spark, tmp_path):
    own = engine(tmp_path, "values " + ", ".join(f"({'null' if p is None else p}, {'null' if t is None else t})" for p, t in PLANTED))
    assert same_rows(spark, tmp_path, own) == (8 * 5, 0)


def test_commitments_near_the_largest_number(spark, tmp_path):
    own = engine(tmp_path, "values (1, 1e15), (2, 5e16)")
    assert same_rows(spark, tmp_path, own) == (16, 0)


@pytest.mark.parametrize("years", [1, 3])
def test_years_by_a_ledger(spark, years):
    expected = []
    for key, commitment in ((1, 1000), (2, 7), (3, 3)):
        called = nav = 0
        for age in range(1, years + 1):
            call = (commitment - called) // 4
            called, nav = called + call, nav * 110 // 100 + call
            expected.append((key, age, called, nav))
    found = projection(spark.createDataFrame([(1, 1000), (2, 7), (3, 3)], "k long, c long"), ["k"], "c", years)
    assert sorted(tuple(r) for r in found.collect()) == expected
