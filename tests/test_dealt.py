"""Large tables are dealt by key in parts of so many lines, with the rows of the SQL."""

import duckdb
import pytest

from ledgerline import registry
from ledgerline.operators import hierarchy
from ledgerline.plans import dialect

NAMES = ["a06_02_duplicates", "a06_03_contiguity", "b02_05_restatement", "b08_05_overlap", "b12_16_harvest", "b15_04_data_quality", "b18_01_correcting_entries"]


@pytest.fixture(scope="module")
def engine(sf_dir):
    own = duckdb.connect()
    own.sql("set timezone = 'UTC'")
    for t in dialect.TABLES:
        own.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return own


@pytest.fixture
def few_lines(monkeypatch):
    monkeypatch.setattr(dialect, "LINES", 400)


@pytest.mark.parametrize("name", NAMES)
def test_dealt_rows_are_those_of_the_sql(spark, sf_dir, engine, few_lines, name):
    n = dialect.parts(spark, sf_dir)
    assert n == -(-engine.sql("select count(*) from lineitem").fetchall()[0][0] // 400) > dialect.FEW
    q = registry.everything()[name]
    frame = q.run(spark, sf_dir)
    assert f", {n})" in frame._jdf.queryExecution().executedPlan().toString()  # hashpartitioning(key, n)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.select(*columns).toArrow().to_pylist())
    assert got == sorted(str(r) for r in engine.sql(q.oracle).select(*columns).fetchall())


def test_few_lines_are_not_dealt(spark, sf_dir):
    assert dialect.parts(spark, sf_dir) == 0
    assert ":parts" not in registry.everything()["a06_02_duplicates"].run(spark, sf_dir)._jdf.queryExecution().toString()


def test_pairs_and_edges_are_dealt_in_parts_of_their_own(spark, sf_dir, engine, monkeypatch):
    monkeypatch.setitem(dialect._LINES, sf_dir, 10_000_000)
    for name, n in (("b08_09_manager_overlap", 50), ("a08_06_inverse", 40)):
        q = registry.everything()[name]
        frame = q.run(spark, sf_dir)
        assert f", {n})" in frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
        columns = sorted(frame.columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in frame.select(*columns).toArrow().to_pylist()) == sorted(str(r) for r in engine.sql(q.oracle).select(*columns).fetchall())


def test_look_through_of_many_edges_is_dealt(spark, monkeypatch):
    counted = []
    whole = hierarchy.dealt
    monkeypatch.setattr(hierarchy, "dealt", lambda frame, rows, *keys: counted.append(rows) or whole(frame, rows, *keys, each=10))
    edges = [(f"r{i}", f"m{i % 7}", 0.5) for i in range(100)] + [(f"m{i}", f"l{k}", 0.25) for i in range(7) for k in range(4)] + [("x", "y", 1.0), ("y", "x", 0.5), ("y", "l0", 0.5)]
    found = hierarchy.look_through(spark.createDataFrame(edges, "owner string, owned string, weight double"), spark.createDataFrame([(f"r{i}",) for i in range(100)] + [("x",)], "root string"))
    expected = sorted([(f"r{i}", f"l{k}", 0.125) for i in range(100) for k in range(4)] + [("x", "l0", 0.5)])
    assert sorted(tuple(r) for r in found.collect()) == expected and max(counted) == len(edges)


def test_edges_of_a_verb_are_not_one_task(spark, sf_dir):
    plan = registry.everything()["a08_06_inverse"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [verb" not in plan
