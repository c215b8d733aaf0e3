"""Operators on planted rows: what must be found, what must not."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline import registry
from ledgerline.operators import graph
from ledgerline.operators.catalog import Catalog
from ledgerline.operators.hierarchy import look_through
from ledgerline.operators.lots import relieve, relieve_least_tax, wash_sales
from ledgerline.operators.ranking import in_groups, in_order, ntile, percent_rank
from ledgerline.operators.reconcile import allocate, reconcile
from ledgerline.operators.returns import black, bootstrap, compile_metric, evaluate_terms, irr, least_variance, normal_cdf, performance_fees
from ledgerline.operators.rules import Rule, gaps, not_unique, report, unresolved
from ledgerline.operators.screening import screen
from ledgerline.operators.temporal import as_of_join, close_versions, effective_at, episodes, latest, restatements, with_unknown
from ledgerline.plans.dialect import expand


def test_look_through_of_layers_of_diamonds(spark):
    """Twenty layers of two nodes have a million paths, and two rows a round."""
    edges = [(f"{k}{a}", f"{k + 1}{b}", 0.5) for k in range(20) for a in "xy" for b in "xy"] + [("r", "0x", 0.25), ("r", "0y", 0.75)]
    found = look_through(spark.createDataFrame(edges, "owner string, owned string, weight double"), spark.createDataFrame([("r",)], "root string"))
    assert rows(found, "root", "leaf", "weight") == [("r", "20x", 0.5), ("r", "20y", 0.5)]


def test_look_through_of_cycles_with_ways_in_and_out(spark):
    edges = [("r", "a", 0.5), ("r", "x", 0.5), ("a", "b", 0.4), ("b", "a", 0.3), ("b", "z", 0.7), ("a", "y", 0.6), ("x", "y", 1.0), ("s", "s", 0.5), ("s", "y", 0.5)]
    found = look_through(spark.createDataFrame(edges, "owner string, owned string, weight double"), spark.createDataFrame([("r",), ("b",), ("s",)], "root string"))
    assert [(a, b, round(w, 9)) for a, b, w in rows(found, "root", "leaf", "weight")] == [("b", "y", 0.18), ("b", "z", 0.7), ("r", "y", 0.8), ("r", "z", 0.14), ("s", "y", 0.5)]


def test_ranks_in_groups_that_span_ranges(spark):
    r = random.Random(2)
    made = [(r.choice("aaab") if k else "z", r.randint(0, 20), k) for k in range(300)]
    found = in_groups(spark.createDataFrame(made, "g string, v int, id int"), ["g"], [F.col("v")]).withColumn("part", ntile(F.col("row"), F.col("rows"), 4)).collect()
    for g in "abz":
        own = sorted(v for h, v, _ in made if h == g)
        mine = sorted((f.row, f.v, f.rank, f.rows, f.part) for f in found if f.g == g)
        assert [m[:4] for m in mine] == [(k + 1, v, own.index(v) + 1, len(own)) for k, v in enumerate(own)]
        sizes = [sum(m[4] == q for m in mine) for q in (1, 2, 3, 4)]
        assert sum(sizes) == len(own) and sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


def test_chain_ends(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 40)]
    found = graph.chain_ends(spark.createDataFrame(edges, "src int, dst int"))
    assert rows(found, "start", "last", "depth") == [(k, 40, 40 - k) for k in range(40)] + [(200, 40, 1)]


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 5, "c")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 9, 90)], "k int, u int, v int")
    assert rows(as_of_join(left, right, ["k"], "t", "u", ["v"]), "n", F.coalesce("v", F.lit(-1))) == [("a", 50), ("b", -1), ("c", -1)]
    assert rows(as_of_join(left, right, ["k"], "t", "u", ["v"], strict=True), "n", F.coalesce("v", F.lit(-1))) == [("a", 20), ("b", -1), ("c", -1)]
    assert rows(as_of_join(left, right, ["k"], "t", "u", ["v"], forward=True), "n", F.coalesce("v", F.lit(-1))) == [("a", 50), ("b", 20), ("c", -1)]


def test_versions_close_and_are_in_force_at_a_date(spark):
    v = close_versions(spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "k int, effective_from int, name string"), ["k"], "effective_from", [])
    facts = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20)], "k int, d int")
    assert rows(effective_at(facts, v, ["k"], "d"), "d", F.coalesce("name", F.lit("-"))) == [(9, "-"), (10, "x"), (19, "x"), (20, "y")]


def test_latest_restatements_unknown_episodes(spark):
    f = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 7), (2, 1, 1)], "k int, t int, v int")
    assert rows(latest(f, ["k"], [F.col("t")]), "k", "v") == [(1, 7), (2, 1)]
    assert rows(restatements(f, ["k"], ["t"], "v"), "k", "t", "previous") == [(1, 3, 5)]
    assert rows(with_unknown(f, spark.createDataFrame([(1,)], "k int"), "k"), "k", "member") == [(1, 1), (1, 1), (1, 1), (2, -1)]
    assert rows(episodes(f, ["k"], ["t"], F.col("v") < 6).groupBy("k", "episode").count(), "k", "episode", "count") == [(1, 1, 2), (2, 1, 1)]


def test_reconciliation_names_each_cause(spark):
    a = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "k int, q int")
    b = spark.createDataFrame([(1, 10), (2, 11), (3, 30), (5, 1)], "k int, q int")
    assert rows(reconcile(a, b, ["k"], "q", 5), "k", "cause") == [(1, "match"), (2, "within_tolerance"), (3, "break"), (4, "missing_right"), (5, "missing_left")]


def test_allocation_keeps_the_total(spark):
    f = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1)], "g string, k int, w int").withColumn("pot", F.lit(100))
    assert rows(allocate(f, ["g"], "w", "pot", ["k"]), "k", "share") == [(1, 34), (2, 33), (3, 33)]


def test_lots_in_order(spark):
    buys = spark.createDataFrame([(1, 1, 10), (1, 2, 10)], "i int, d int, q long")
    sells = spark.createDataFrame([(1, 5, 12)], "i int, d int, q long")
    assert rows(relieve(buys, sells, ["i"], "q", ["d"], ["d"]), "lot_d", "matched") == [(1, 10), (2, 2)]
    assert rows(relieve(buys, sells, ["i"], "q", [F.desc("d")], ["d"]), "lot_d", "matched") == [(1, 2), (2, 10)]


def test_look_through_adds_diamonds_and_ends_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "d", 0.4), ("c", "d", 0.6), ("c", "a", 0.4)], "owner string, owned string, weight double")
    assert rows(look_through(edges, spark.createDataFrame([("a",)], "root string")), "leaf", F.round("weight", 6)) == [("d", 0.5)]


def test_irr_and_metric(spark):
    flows = spark.createDataFrame([(1, 0, -60.0), (1, 0, -40.0), (1, 1461, 146.41), (2, 0, 5.0)], "k int, t int, a double")
    found = dict(rows(irr(flows, ["k"], "t", "a").withColumn("irr", F.coalesce(F.round("irr", 6), F.lit(-9.0))), "k", "irr"))
    assert found == {1: 0.1, 2: -9.0}
    assert flows.agg(compile_metric({"op": "div", "args": [{"op": "sum", "args": [{"col": "a"}]}, {"value": 5}]}).alias("x")).first().x == (5 - 60 - 40 + 146.41) / 5
    with pytest.raises(ValueError):
        compile_metric({"op": "eval", "args": []})


def test_text_functions(spark):
    f = spark.createDataFrame([("# SD-1.2 — Élan Vital\n\n## Purpose\n\nFirst *bold* [link](u).\n\n## Next\nx",)], "t string")
    r = f.select(X.fold(F.lit("Élan")).alias("f"), X.tokens(F.lit("The SD-1.2 the a é9")).alias("t"), X.slug(F.lit(" Élan Vital! ")).alias("s"), X.heading(F.col("t"))["title"].alias("h"), X.clean_inline(X.section(F.col("t"), "Purpose")).alias("p"), X.references(F.col("t"), r"SD-\d+\.\d+").alias("r"), X.line_number(F.col("t"), F.lit("Purpose")).alias("l"), X.anchors(F.lit("<a href='x'>")).alias("a"), X.list_items(F.lit("<li> a <b>c</b></li>")).alias("i")).first()
    assert (r.f, r.t, r.s, r.h, r.p, r.r, r.l, r.a, r.i) == ("elan", ["the", "sd", "1.2", "e9"], "e-lan-vital", "Élan Vital", "First bold link.", ["SD-1.2"], 3, ["x"], ["a c"])


def test_catalogue(spark):
    c = Catalog(spark.createDataFrame([("E-1", "entity", "Legal entity", "a party", "text"), ("E-2", "entity", "Asset", "legal", "x"), ("S-1", "service", "Other", "y", "z")], "id string, type string, title string, description string, content string"))
    assert rows(c.search("legal entity"), "id", "score") == [("E-1", 80 + 35 + 2 * 10), ("E-2", 5)]
    assert rows(c.get("e-2"), "title") == [("Asset",)]
    assert c.search("legal", 99, ["service"]).count() == 0
    with pytest.raises(ValueError):
        c.search("x")


def test_graph_and_rules(spark):
    edges = spark.createDataFrame([("a", "b", "owns"), ("a", "b", "owns"), ("a", "a", "owns"), ("b", "z", "owns")], "src string, dst string, verb string")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, label string")
    assert graph.union_edges(edges).count() == 2
    assert rows(graph.match(graph.union_edges(edges), nodes, "owns"), "src_label", "dst_label") == [("A", "B")]
    assert rows(graph.without(edges, nodes, "owns"), "id") == [("c",)]
    assert rows(graph.dangling(edges, nodes), "dst") == [("z",)]
    t = {"e": spark.createDataFrame([(1, 1), (1, 9), (4, 1)], "k int, f int"), "n": spark.createDataFrame([(1,)], "id int")}
    found = report([Rule("ref", "error", unresolved("e", "f", "n", "id")), Rule("key", "error", not_unique("e", ["k"])), Rule("gap", "warning", gaps("e", "k"))], t)
    assert rows(found, "rule", "subject") == [("gap", "2"), ("gap", "3"), ("key", "1"), ("ref", "9")]


def test_dialects():
    text = "select DAYS(d, date '2024-01-01') as n from obs where v > 0.5"
    assert "datediff(d, date '2024-01-01')" in expand(text, "n l", 0) and "date_diff('day', date '2024-01-01', d)" in expand(text, "n l", 1)
    assert "0.5e0" in expand(text, "n l", 0)


def test_markdown_source(spark, tmp_path):
    from ledgerline.sources.files import catalogue, graph_csv, markdown_items, read_document, write_catalogue

    (tmp_path / "md" / "a").mkdir(parents=True)
    (tmp_path / "md" / "a" / "E-01.md").write_text("# E-01 — Legal Entity\n\n## Purpose\n\nA *party* to trades.\n\n## Next\n\nx\n")
    (tmp_path / "md" / "E-02.md").write_text("# E-02 - Asset\n\nNo purpose here.\n")
    items = markdown_items(spark, str(tmp_path / "md"), "entity", {"repository": "r", "tag": "t", "official": "o"})
    assert rows(items, "id", "title", "description") == [("E-01", "Legal Entity", "A party to trades."), ("E-02", "Asset", "No purpose here.")]
    write_catalogue(items, str(tmp_path / "out"), "1")
    assert read_document(spark, str(tmp_path / "out")).count() == catalogue(spark, str(tmp_path / "out")).count() == 2
    write_catalogue(items, str(tmp_path / "one"), "1", {"by": "us"}, files=1)
    (one,) = (tmp_path / "one").glob("part-*")
    whole = json.loads(one.read_text())
    assert [i["id"] for i in whole["items"]] == sorted(r.id for r in items.collect()) and whole["modelVersion"] == "1" and sum(whole["counts"].values()) == 2
    for part in (tmp_path / "out").glob("part-*"):
        json.loads(part.read_text())
    (tmp_path / "c.json").write_text('{"items": [{"id": "a"}, {"id": "b"}]}')
    assert rows(catalogue(spark, str(tmp_path / "c.json")), "id") == [("a",), ("b",)]
    (tmp_path / "n.csv").write_text("id,label\na,\n")
    assert rows(graph_csv(spark, str(tmp_path / "n.csv"), "id string, label string"), "id", "label") == [("a", "")]


@pytest.fixture(scope="module")
def far_ids(spark, tmp_path_factory):
    """Tables with ids beyond all those that the queries over subsets take."""
    at = tmp_path_factory.mktemp("far")
    day = "timestamp '1999-01-01'"
    lines = [(1, 500, 300), (1, 501, 301), (2, 500, 301), (3, 500, 300), (3, 500, 5)]  # order, part, supplier
    made = {
        "lineitem": f"select o as l_orderkey, p as l_partkey, s as l_suppkey, 1 as l_linenumber, 4.0D as l_quantity, 8.0D as l_extendedprice, 0.0D as l_discount, 0.0D as l_tax, if(o = 3, 'R', 'N') as l_returnflag, 'F' as l_linestatus, {day} as l_shipdate from values {', '.join(map(str, lines))} as t(o, p, s)",
        "orders": f"select k as o_orderkey, c as o_custkey, 'F' as o_orderstatus, 8.0D as o_totalprice, {day} as o_orderdate, '1' as o_orderpriority from values (1, 700), (2, 700), (3, 701) as t(k, c)",
        "part": "select k as p_partkey, 'x' as p_name, 'b' as p_brand, 't' as p_type, 1 as p_size, 73.0D as p_retailprice from values (5), (500), (501) as t(k)",
    }
    for name, text in made.items():
        spark.sql(text).coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def test_queries_leave_no_id_out(spark, far_ids):
    found = lambda name, *c: rows(registry.queries()[name](spark, far_ids), *c)
    assert found("b08_04_look_through", "root", "leaf", "weight") == [("P700", "I500", 0.666667), ("P700", "I501", 0.333333)]
    assert found("b08_09_manager_overlap", "a", "b", "shared") == [(5, 300, 1), (5, 301, 1), (300, 301, 1)]
    assert found("a07_05_union_dedup", "src", "dst", "kind") == [(700, 500, "buy"), (700, 501, "buy"), (701, 500, "sell")]
    accrued = found("b03_08_income_accrual", "instrument_id", "accrued")
    assert accrued == [(k, d) for k in (5, 500, 501) for d in range(1, 11)]


def test_queries_read_whole_texts(spark, tmp_path):
    names = [(1, "Long " * 20 + "End"), (2, "Net  Asset Value feeds"), (3, "Net Asset"), (4, "Single"), (5, "Gone Away")]
    texts = [(1, "xx long LONG yy"), (2, "The net asset value"), (2, "other"), (3, "Net of Asset"), (4, "Single")]
    spark.createDataFrame(names, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = lambda name, *c: rows(registry.queries()[name](spark, str(tmp_path)), *c)
    prefixes = lambda name: [" ".join(name.split()[:n]).lower() for n in range(2, len(name.split()) + 1)]
    assert found("a05_12_cited_text", "item_id", "cited") == [(i, any(p in t.lower() for d, t in texts if d == i for p in prefixes(name))) for i, name in names]
    assert found("a03_08_slug", "item_id", "slug")[0] == (1, "long-" * 20 + "end")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_screening_misses_no_name_at_distance_one(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(80)] + ["Acme", "Xcme", "Acm", "Acmee"]
    names = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id int, name string")
    listed = spark.createDataFrame([(k, w) for k, w in enumerate(words[::3])], "listed int, alias string")
    assert rows(screen(names, listed), "id", "listed", "distance") == sorted((i, j, distance(a, b)) for i, a in enumerate(words) for j, b in enumerate(words[::3]) if distance(a, b) <= 1)


def pieces_by_queue(buys, sells):
    """First in first out by a queue of open lots."""
    lots, out = [[q, d] for d, q in sorted(buys)], []
    for d, q in sorted(sells):
        while q and lots:
            n = min(q, lots[0][0])
            if n:
                out.append((lots[0][1], d, n))
            lots[0][0] -= n
            q -= n
            if not lots[0][0]:
                lots.pop(0)
    return sorted(out)


def test_lots_against_a_queue(spark):
    r = random.Random(5)
    sides = {k: ([(d, r.randint(0, 9)) for d in range(r.randint(0, 12))], [(d, r.randint(0, 9)) for d in range(r.randint(0, 12))]) for k in range(60)}
    make = lambda n: spark.createDataFrame([(k, d, q) for k, s in sides.items() for d, q in s[n]], "k int, d int, q long")
    found = rows(relieve(make(0), make(1), ["k"], "q", ["d"], ["d"]), "k", "lot_d", "sale_d", "matched")
    assert found == sorted((k, *p) for k, (b, s) in sides.items() for p in pieces_by_queue(b, s))


def test_least_tax_takes_the_best_lot_each_time(spark):
    r = random.Random(6)
    trades = {k: [(r.randint(0, 900), s, r.choice([1, 1, -1]), r.randint(1, 5), r.randint(10, 30)) for s in range(40)] for k in range(20)}
    want = {}
    for k, own in trades.items():
        lots, out = [], [0, 0, 0]
        for day, seq, side, qty, price in sorted(own, key=lambda t: (t[0], -t[2], t[1])):
            if side > 0:
                lots.append([qty, price, day])
                continue
            for _ in range(qty):  # unit by unit
                tax = [((0.2 if day - d > 365 else 0.35) * (price - p), day - d > 365, p) for n, p, d in lots if n]
                if not tax:
                    break
                best = min(tax)
                lot = next(x for x in lots if x[0] and (price - x[1], day - x[2] > 365) == (price - best[2], best[1]))
                lot[0] -= 1
                out = [out[0] + 1, out[1] + price - lot[1], out[2] + best[1]]
        want[k] = tuple(out)
    frame = spark.createDataFrame([(k, *t) for k, own in trades.items() for t in own], "k int, day int, seq long, side int, qty long, price long")
    found = relieve_least_tax(frame, "k").groupBy("k").agg(F.sum("matched"), F.sum("gain"), F.sum(F.expr("if(is_long, matched, 0)")))
    assert {x[0]: tuple(x[1:]) for x in found.collect()} == {k: w for k, w in want.items() if w[0]}


def test_wash_sales_look_both_ways(spark):
    pieces = spark.createDataFrame([(1, "2024-03-01", 10, -100), (1, "2024-03-01", 5, 50), (1, "2024-06-01", 4, -40)], "i int, sale_day string, matched long, gain long").withColumn("sale_day", F.col("sale_day").cast("date"))
    buys = spark.createDataFrame([(1, "2024-01-31", 3), (1, "2024-03-31", 2), (1, "2024-04-01", 9), (2, "2024-03-01", 9)], "i int, day string, qty long").withColumn("day", F.col("day").cast("date"))
    assert rows(wash_sales(pieces, buys, "i"), F.col("day").cast("string"), "loss", "loss_qty", "replaced", "disallowed") == [("2024-03-01", -100, 10, 5, 50), ("2024-06-01", -40, 4, 0, 0)]


def test_models(spark):
    one = spark.range(1)
    x = one.select(*[normal_cdf(F.lit(v)).alias(f"x{k}") for k, v in enumerate((-3.0, -0.5, 0.0, 1.7))], black(F.lit(100.0), F.lit(95.0), F.lit(0.2), F.lit(0.5), F.lit(0.98)).alias("c"), black(F.lit(100.0), F.lit(95.0), F.lit(0.2), F.lit(0.5), F.lit(0.98), call=False).alias("p")).first()
    exact = lambda v: 0.5 * (1 + math.erf(v / 2**0.5))
    assert all(abs(x[k] - exact(v)) < 1e-7 for k, v in enumerate((-3.0, -0.5, 0.0, 1.7))) and abs(x.c - x.p - 0.98 * 5) < 1e-9
    rates = spark.createDataFrame([("a", m, 0.05) for m in (1, 2, 3, 5, 6)] + [("b", 2, 0.05)], "c string, m int, r double")
    assert rows(bootstrap(rates, ["c"], "m", "r"), "m", F.round("zero", 9)) == [(1, 0.05), (2, 0.05), (3, 0.05)]
    navs = spark.createDataFrame([("a", k, v) for k, v in enumerate((1000, 1200, 1100, 1300))], "u string, p int, nav long")
    # 20 % of 1200 - 1010 is 38; 1162 is the mark; 1100 - 38 is below it; 1300 - 38 less the mark is 100, of which 20
    assert rows(performance_fees(navs, ["u"], "p", "nav"), "fees", "mark", "crystallised") == [(58, 1242, 2)]
    terms = [("a", "FIXED", "0.5"), ("b", "COMPUTED", '{"op": "case", "args": [{"op": "ge", "args": [{"col": "v"}, {"value": 2}]}, {"value": 7}, {"col": "v"}]}')]
    assert rows(evaluate_terms(spark.createDataFrame([("a", 9), ("b", 2), ("b", 1), ("c", 1)], "k string, v int"), terms, "k", "x"), "k", F.coalesce("x", F.lit(-1.0))) == [("a", 0.5), ("b", 1.0), ("b", 7.0), ("c", -1.0)]


def test_least_variance_beats_other_weights(spark):
    r = random.Random(7)
    series = [[r.gauss(0, 1 + k) for _ in range(30)] for k in range(3)]
    series.append([a * 2 + r.gauss(0, 0.1) for a in series[0]])
    frame = spark.createDataFrame([("g", f"a{k}", t, x) for k, s in enumerate(series) for t, x in enumerate(s)], "g string, a string, t int, x double")
    w = [x.weight for x in least_variance(frame, "g", "a", "t", "x").orderBy("a").collect()]
    spread = lambda w: (lambda p: sum((x - sum(p) / 30) ** 2 for x in p))([sum(a * s[t] for a, s in zip(w, series, strict=True)) for t in range(30)])
    assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0
    for _ in range(300):
        other = [r.random() ** 3 for _ in w]
        assert spread(w) <= spread([x / sum(other) for x in other]) + 1e-9


def test_gaps_within_and_between_ranges(spark):
    from ledgerline.operators.rules import RANGE

    found = report([Rule("gap", "warning", gaps("e", "k"))], {"e": spark.createDataFrame([(RANGE - 2,), (RANGE + 2,), (RANGE + 4,)], "k long")})
    assert sorted(int(x) for (x,) in rows(found, "subject")) == [RANGE - 1, RANGE, RANGE + 1, RANGE + 3]


def test_ranks_and_sums_over_all_rows(spark):
    r = random.Random(9)
    frame = spark.createDataFrame([(k, r.randint(0, 40), r.randint(0, 9)) for k in range(500)], "k int, v int, q long").repartition(7)
    want = sorted(tuple(x) for x in frame.selectExpr("k", "percent_rank() over (order by v)").collect())
    assert rows(percent_rank(frame, "v", "p"), "k", "p") == want
    want = sorted(tuple(x) for x in frame.selectExpr("k", "sum(q) over (order by v, k)", "rank() over (order by v, k)").collect())
    assert rows(in_order(frame, ["v", "k"], "q"), "k", "running", "rank") == want
    assert rows(percent_rank(frame.limit(1), "v", "p"), "p") == [(0.0,)] and in_order(frame.filter("false"), ["v"]).count() == 0


def test_least_tax_of_keys_that_share_a_bucket(spark):
    r = random.Random(9)
    trades = [(k, r.randint(0, 900), s, r.choice([1, 1, -1]), r.randint(1, 5), r.randint(10, 30)) for k in [*range(12), None] for s in range(20)]
    frame = spark.createDataFrame(trades, "k int, day int, seq long, side int, qty long, price long")
    alone = [p for k in [*range(12), None] for p in relieve_least_tax(frame.filter(F.col("k").eqNullSafe(k)), "k", buckets=1).collect()]
    for buckets in (1, 3):
        assert sorted(map(repr, relieve_least_tax(frame, "k", buckets=buckets).collect())) == sorted(map(repr, alone))
