"""How many rows queries move between tasks: shuffles follow the input, not the rounds or the pairs."""

from unittest import mock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import registry
from ledgerline.operators import documents, graph, matching
from ledgerline.shared import scratch
from ledgerline.streaming import monitor


@pytest.fixture
def moved(spark):
    """Rows written to shuffles since the last call."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    seen = set()

    def count():
        total, stages = 0, store.stageList(None, False, False, none, None).iterator()
        while stages.hasNext():
            s = stages.next()
            if s.stageId() not in seen:
                seen.add(s.stageId())
                total += s.shuffleWriteRecords()
        return total

    count()
    return count


def test_an_index_moves_texts_and_blocks_not_words(spark, moved):
    docs = spark.range(512).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: F.concat(F.lit("w"), (x * 7 + F.col("id")) % 150))).alias("text"))
    index = documents.build(docs, scratch(spark, "index"), folders=2)
    assert moved() < 700  # texts, and a count a task; a row a word and text would be 51,200
    found = documents.search(spark, index, spark.createDataFrame([(1, "w1 w2 w3"), (2, "w1 w9")], "query_id int, text string"), 3).collect()
    assert len(found) == 6 and moved() < 1_000  # 8 blocks are dealt; each query's documents would be 500 and more, twice


def _scans(spark, sf_dir, name):
    """Scans of lines that the query's last job does."""
    return registry.everything()[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#")


@pytest.mark.parametrize("name", ["b17_18_track_record", "b07_04_pme", "b17_09_pme_attribution"])
def test_lines_are_read_once_before_the_last_job(spark, sf_dir, name):
    assert _scans(spark, sf_dir, name) == 0  # what they are summed to is written, and read from there


def test_a_walk_by_one_edge_a_source_doubles_its_depth(spark, moved):
    edges = spark.range(1, 200).selectExpr("id as src", "id - 1 as dst").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1002), (1002, 1001), (1003, 1003)], "src long, dst long"))
    found = sorted(tuple(r) for r in graph.reach(edges).collect())
    chain = [(s, n, s - n) for s in range(1, 200) for n in range(s)]
    assert found == sorted(chain + [(1000, 1001, 1), (1000, 1002, 2), (1001, 1002, 1), (1001, 1001, 2), (1002, 1001, 1), (1002, 1002, 2), (1003, 1003, 1)])
    assert moved() < 8 * len(chain)  # a round a depth would read them all 199 times


def test_layers_are_not_read_again(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 11)], "src long, dst long")
    b = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "src long, dst long")  # numbers of another layer
    c = spark.createDataFrame([(1, 1), (2, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.layers([a, b, c]).collect()) == [(1, 1, 2), (1, 1, 3), (1, 2, 2), (1, 10, 1), (1, 11, 1), (2, 1, 2), (2, 1, 3), (2, 2, 2), (2, 11, 1)]


def test_rounds_of_matching_hold_what_can_match(spark, moved):
    far = spark.range(2_000).selectExpr("1 as k", "id * 1000 as amount", "date '2024-01-01' as d", "id")  # nothing near them
    near = spark.range(8).selectExpr("1 as k", "3000000 + id * id as amount", "date '2024-01-01' as d", "10000 + id as id")
    found = matching.match(far.union(near.filter("id % 2 = 0")), near.filter("id % 2 = 1"), ["k"], "amount", "d", "id", 50, 0)
    assert sorted(r.left_id for r in found.collect()) == [10000, 10002, 10004, 10006]
    assert moved() < 3 * 2_000  # once for equal amounts, once for the runs; each round would move them twice again


def test_updates_that_come_or_go_together_are_one_call_of_the_store():
    handle = mock.MagicMock()
    waiting, folded = handle.getListState.return_value, handle.getValueState.return_value
    own = monitor.Monitor([monitor.Range("high", -1000, 10)], 10**9)
    own.init(handle)
    came = [(1000 * k, k, 1) for k in range(50)] + [(3000, 3, 5), (10**6, 99, 1)]
    list(own.handleInputRows((7,), iter([pd.DataFrame(came, columns=["at", "id", "value"])]), None))
    assert waiting.appendList.call_args_list == [mock.call(came)]
    waiting.get.return_value, folded.get.return_value = iter(came), None
    out = pd.concat(own.handleExpiredTimer((7,), mock.Mock(getCurrentWatermarkInMs=lambda: 100), None))
    assert list(out["cause"]) == ["update 6: 11"]  # the third counts 5, once
    assert waiting.put.call_args_list == [mock.call([(10**6, 99, 1)])] and folded.update.call_args_list == [mock.call((54, 49000, 49, False, 1))]
