"""Searching, matching, screening, linking and monitoring on planted rows, against brute force."""

import collections
import datetime
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import derivatives, documents, funds, linkage, matching, performance, risk, screening, similar
from ledgerline.operators.returns import black
from ledgerline.shared import scratch
from ledgerline.streaming import monitor, replay


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)


WORDS = ["Alpha", "beta", "gamma", "the", "of", "été", "x9", "omega"]


def terms_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def searched_by_brute_force(docs, queries, k):
    own = [(i, collections.Counter(terms_of(t))) for i, t in docs if i is not None and terms_of(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in own:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * c.total() * n) // total))) for t in terms_of(text) if df[t])
            scored += [(-score, i)] if score > 0 else []
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,first,k", [(256, 4, 5), (3, 1, 3), (1, 1, 100)])
def test_search_by_an_index(spark, width, first, k):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(WORDS[: 3 + i % 6]) for _ in range(r.randint(1, 25)))) for i in range(-5, 60)] + [(100, None), (101, ""), (102, "..."), (None, "alpha"), (103, "rare alpha")]
    queries = [(1, "alpha the"), (2, "RARE été été"), (3, "nowhere"), (4, ""), (5, None), (6, " ".join(WORDS)), (7, "x9 omega")]
    index = documents.build(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark, "index"), folders=4, width=width)
    found = documents.search(spark, index, spark.createDataFrame(queries, "query_id int, text string"), k, first=first)
    assert rows(found, "query_id", "rank", "doc", "score") == searched_by_brute_force(docs, queries, k)


def test_search_reads_the_folders_of_its_terms(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 50).alias("text"))
    index = documents.build(docs, scratch(spark, "index"), folders=16)
    one = documents.search(spark, index, spark.createDataFrame([(1, "word7")], "query_id int, text string"))
    assert sorted(r.doc for r in one.collect()) == [7, 57, 107, 157]
    read = [line for line in one._jdf.queryExecution().executedPlan().toString().split("\n") if "postings" in line]
    assert read and all(re.search(r"PartitionFilters: \[.*folder", line) for line in read)
    nothing = documents.build(docs.filter("false"), scratch(spark, "index"), folders=2)
    assert nothing.n_docs == 0


def test_links_by_discriminator(spark):
    links = spark.createDataFrame([(1, "party", 5), (2, "party", 6), (3, "order", 5), (4, "page", 5), (5, None, 5), (6, "order", None)], "doc int, target_type string, target_id long")
    targets = {"party": spark.createDataFrame([(5, "Ann")], "target_id long, label string"), "order": spark.createDataFrame([(5, 77)], "target_id int, label int")}
    assert rows(documents.resolve(links, targets), "doc", "label", "state") == [(1, "Ann", "resolved"), (2, None, "dangling"), (3, "77", "resolved"), (4, None, "unknown_type"), (5, None, "unknown_type"), (6, None, "empty")]


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def check_match(left, right, found, tolerance, days):
    by = [{i: (k, a, d) for i, k, a, d in side} for side in (left, right)]
    assert len({m.left_id for m in found}) == len(found) == len({m.right_id for m in found})
    for m in found:
        (k, a, d), (k2, a2, d2) = by[0][m.left_id], by[1][m.right_id]
        assert k == k2 and abs(a - a2) <= tolerance and abs((d - d2).days) <= days and m.gap == abs(a - a2) and m.days == (d2 - d).days
        assert (m.stage == "exact") == (a == a2 and d == d2) or m.gap == 0
    # exact matches are as many as there can be; nothing that is left could still match
    count = [collections.Counter(v for v in side.values() if None not in v) for side in by]
    assert sum(m.stage == "exact" for m in found) == sum((count[0] & count[1]).values())
    free = [[v for i, v in side.items() if i not in {(m.left_id, m.right_id)[n] for m in found} and None not in v] for n, side in enumerate(by)]
    assert not any(k == k2 and abs(a - a2) <= tolerance and abs((d - d2).days) <= days for (k, a, d), (k2, a2, d2) in itertools.product(*free))


def test_matching_in_a_tolerance(spark):
    r = random.Random(8)
    schema = "id long, k int, a long, d date"
    side = lambda n, start: [(start + i, r.randint(1, 3), r.choice([100, 101, 105, 110, 150, r.randint(0, 300)]), day(r.randint(0, 5))) for i in range(n)]
    left, right = side(120, 0), side(110, 1000)
    left += [(500, 9, 100, day(1)), (501, 9, 110, day(1)), (502, 9, 120, day(1)), (503, None, 5, day(1)), (504, 9, None, day(1)), (505, 9, 7, None)]
    right += [(1500, 9, 105, day(1)), (1501, 9, 115, day(1)), (1502, None, 5, day(1)), (1503, 9, 120, day(2))]
    found = matching.match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "a", "d", "id", 10, 1).collect()
    check_match(left, right, found, 10, 1)
    assert 502 in {m.left_id for m in found} and not {m.left_id for m in found} & {503, 504, 505}
    assert {(m.stage, m.days) for m in found} == {("exact", 0), ("tolerance", 0), ("tolerance", 1), ("tolerance", -1)}
    again = matching.match(spark.createDataFrame(left, schema), spark.createDataFrame(right[:0], schema), ["k"], "a", "d", "id", 10, 1)
    assert again.collect() == []


def test_matching_forms_no_pairs_of_a_hot_instrument(spark):
    """Two thousand rows of a key and day, all within the tolerance of each other: all match, in few rounds."""
    left = spark.range(2000).selectExpr("id", "1 as k", "id * 2 as a", "date '2024-01-01' as d")
    right = spark.range(2000).selectExpr("id + 5000 as id", "1 as k", "id * 2 + 1 as a", "date '2024-01-01' as d")
    found = matching.match(left, right, ["k"], "a", "d", "id", 100_000, 0)
    assert found.count() == 2000


def test_edits():
    lev = lambda a, b: screening.edits(a, b)
    assert [lev(*x) for x in (("", ""), ("a", ""), ("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"), ("abcd", "badc"))] == [0, 1, 1, 2, 3, 2]


def test_no_name_within_two_edits_is_missed(spark):
    r = random.Random(4)
    names = ["Anna Bell", "Иван Петров", "Müller & Sons", "Al", "B", "Παύλος Νίκος", "Anna  BELL", "o'neil trading ltd"]
    spelt = ["anna bell", "ivan petrov", "muller sons", "al", "b", "paylos nikos", "anna bell", "o neil trading ltd"]
    assert [x[0] for x in spark.createDataFrame([(n,) for n in names], "n string").select(screening.spelling(F.col("n"))).collect()] == spelt

    def spoil(text):
        for _ in range(r.randint(0, 2)):
            k, c = r.randrange(len(text)), r.choice("abcxyz")
            text = r.choice([text[:k] + text[k + 1 :], text[:k] + c + text[k:], text[:k] + c + text[k + 1 :], text[:k] + text[k : k + 2][::-1] + text[k + 2 :]]) or "q"
        return text

    listed = [(100 * i + j, spoil(s)) for i, s in enumerate(spelt) for j in range(6)] + [(900, "Bell, Anna"), (901, "sons muller"), (902, "..."), (903, None), (904, "nobody at all")]
    found = rows(screening.screen_names(spark.createDataFrame(list(enumerate(names)), "party_id int, name string"), spark.createDataFrame(listed, "listed int, alias string")), "party_id", "listed", "form", "distance")
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()
    want = []
    for (i, s), (j, t) in itertools.product(enumerate(spelt), listed):
        t = plain(t)
        a, z = screening.edits(s, t), screening.edits(" ".join(sorted(s.split())), " ".join(sorted(t.split())))
        if t and min(a, z) <= 2:
            want.append((i, j, "written" if a <= z else "words", min(a, z)))
    assert found == sorted(want, key=repr)
    assert (0, 900, "words", 0) in found


def test_weights_equal_a_direct_fit(spark):
    r = np.random.default_rng(3)
    m, u, part = np.array([0.95, 0.8, 0.7]), np.array([0.02, 0.1, 0.3]), 0.2
    true = r.random(20_000) < part
    x = (r.random((20_000, 3)) < np.where(true[:, None], m, u)).astype(int)
    patterns, counts = np.unique(x, axis=0, return_counts=True)
    w = linkage.fit(patterns, counts, rounds=2000)
    assert abs(w.part - part) < 0.03 and np.abs(w.m - m).max() < 0.05 and np.abs(w.u - u).max() < 0.05
    # the same over all pairs, not over patterns
    p, mm, uu = 0.1, np.full(3, 0.9), np.full(3, 0.1)
    for _ in range(50):
        a, b = p * np.where(x, mm, 1 - mm).prod(axis=1), (1 - p) * np.where(x, uu, 1 - uu).prod(axis=1)
        s = a / (a + b)
        p, mm, uu = s.mean(), (s[:, None] * x).sum(0) / s.sum(), ((1 - s)[:, None] * x).sum(0) / (1 - s).sum()
    few = linkage.fit(patterns, counts, rounds=50)
    assert np.allclose(few.m, mm) and np.allclose(few.u, uu) and np.isclose(few.part, p)


def test_blocks_are_split_and_not_cut(spark):
    left = spark.createDataFrame([(i, "hot" if i < 40 else f"k{i}", i % 4) for i in range(50)], "l int, k string, n int")
    right = spark.createDataFrame([(i + 100, "hot" if i < 40 else f"k{i}", i % 4) for i in range(50)], "r int, k string, n int")
    whole = linkage.candidates(left, right, [[F.col("k"), F.col("n")]], "l", "r", most=1000)
    assert whole.count() == 40 * 40 + 10
    split = linkage.candidates(left, right, [[F.col("k"), F.col("n")]], "l", "r", most=20)
    assert split.count() == 4 * 10 * 10 + 10
    assert linkage.candidates(left, right, [[F.col("k")]], "l", "r", most=20).count() == 40 * 40 + 10  # nothing left to split by
    assert linkage.candidates(left, right, [[F.when(F.col("k") == "hot", None).otherwise(F.col("k"))], [F.col("k")]], "l", "r").count() == 40 * 40 + 10


def test_linkage_finds_spoilt_records(spark):
    r = random.Random(1)
    own = [(i, f"n{i}", i % 7, r.randint(0, 9)) for i in range(200)]
    feed = [(1000 + i, n if i % 5 else "typo", c if i % 6 else (c + 1) % 7, v) for i, n, c, v in own if i % 2] + [(5000, "n2", 2, own[2][3]), (5001, "n2", 2, own[2][3])]
    left, right = spark.createDataFrame(own, "l int, name string, nation int, v int"), spark.createDataFrame(feed, "r int, name2 string, nation2 int, v2 int")
    pairs = linkage.candidates(left.withColumn("k", F.col("name")), right.withColumn("k", F.col("name2")), [[F.col("k")]], "l", "r").unionByName(linkage.candidates(left.withColumn("k", F.col("v")), right.withColumn("k", F.col("v2")), [[F.col("k")]], "l", "r")).distinct()
    fields = {"name": F.col("name") == F.col("name2"), "nation": F.col("nation") == F.col("nation2"), "v": F.col("v") == F.col("v2")}
    scored, weights = linkage.link(left, right, fields, pairs, "l", "r", 0.0, 4.0)
    matched = {(a, b) for a, b in rows(scored.filter("state = 'match'"), "left_id", "right_id")}
    assert {(i, 1000 + i) for i in range(200) if i % 2 and i % 5} == matched
    assert rows(scored.filter("left_id = 2 and right_id >= 5000"), "right_id", "state") == [(5000, "review"), (5001, "review")]  # a tie is for the steward
    assert weights.agree[0] > weights.agree[1] > 0


def test_pairs_of_blocks_are_scored_without_an_exchange_of_pairs(spark):
    r = random.Random(2)
    left = spark.createDataFrame([(i, f"n{r.randint(0, 40)}", r.randint(0, 4), r.randint(0, 9)) for i in range(150)], "l int, name string, nation int, v int")
    right = spark.createDataFrame([(1000 + i, f"n{r.randint(0, 40)}", r.randint(0, 4), r.randint(0, 9)) for i in range(150)], "r int, name2 string, nation2 int, v2 int")
    fields = {"name": F.col("name") == F.col("name2"), "nation": F.col("nation") == F.col("nation2"), "v": F.col("v") == F.col("v2")}
    blocks = [([F.col("name")], [F.col("name2")]), ([F.col("nation"), F.col("v")], [F.col("nation2"), F.col("v2")])]
    common = [left.selectExpr("l", "name as a", "nation as b", "v as c"), right.selectExpr("r", "name2 as a", "nation2 as b", "v2 as c")]
    pairs = linkage.candidates(*common, [[F.col("a")], [F.col("b"), F.col("c")]], "l", "r", most=20)
    given, one = linkage.link(left, right, fields, pairs, "l", "r", -1.0, 3.0)
    found, other = linkage.link_blocks(left, right, fields, blocks, "l", "r", -1.0, 3.0, most=20)
    columns = ["left_id", "right_id", "weight", "state"]
    assert rows(found, *columns) == rows(given, *columns) and len({s for *_, s in rows(found, *columns)}) > 1
    assert np.allclose(one.m, other.m) and np.allclose(one.u, other.u)
    met = linkage.in_blocks(*linkage.keyed(left, right, blocks, 20), 2).select("l", "r")
    assert met.count() == met.distinct().count() == pairs.count()  # each once, without a distinct


def waterfall_by_a_ledger(deals, carry=20):
    lost = owed = due = 0
    out = []
    for cost, preferred, proceeds in deals:
        lost, owed, left = lost + cost, owed + preferred, proceeds
        back = min(lost, left)
        lost, left = lost - back, left - back
        paid = min(owed, left)
        owed, left = owed - paid, left - paid
        due += paid * carry // (100 - carry)
        caught = min(due, left)
        due, left = due - caught, left - caught
        out.append((back, paid, caught, caught + left * carry // 100, back + paid + left - left * carry // 100))
    return out


def test_waterfalls(spark):
    r = random.Random(6)
    deals = [(f, k, r.randint(0, 100), r.randint(0, 10), r.choice([0, r.randint(0, 250)])) for f in range(4) for k in range(12)]
    frame = spark.createDataFrame(deals, "f int, k int, c long, p long, x long")
    found = funds.waterfall(frame, ["f"], ["k"], "c", "p", "x")
    columns = ("returned", "preferred_paid", "catch_up", "carried", "to_investors")
    got = {(x.f, x.k): tuple(x[c] for c in columns) for x in found.collect()}
    assert got == {(f, k): w for f in range(4) for k, w in enumerate(waterfall_by_a_ledger([d[2:] for d in deals if d[0] == f]))}
    # the whole fund's capital first: carry comes no earlier, and never more in all while deals are open
    whole = frame.withColumns({"c": F.when(F.col("k") == 0, 100 * 12).otherwise(0), "p": F.lit(0)})
    each = frame.withColumns({"c": F.lit(100), "p": F.lit(0)})
    total = lambda x: rows(funds.waterfall(x, ["f"], ["k"], "c", "p", "x").groupBy("f").agg(F.sum("carried")))
    assert all(a[1] <= b[1] for a, b in zip(total(whole), total(each), strict=True)) and total(whole) != total(each)


def test_monitor_with_late_and_repeated_events(spark):
    """Events come in several files, out of order and twice; the stream gives what the history of all gives."""
    for k, v in monitor.STORE.items():
        spark.conf.set(k, v)
    r = random.Random(12)
    start = datetime.datetime(2024, 3, 1)
    made = [(i, i % 3, start + datetime.timedelta(minutes=r.randint(0, 3000), microseconds=r.randint(0, 999_999)), r.randint(-80, 80)) for i in range(120)]
    made.sort(key=lambda e: e[2])
    late = [made[k] for k in sorted(range(120), key=lambda k: k + r.randint(0, 12))]  # by at most some steps out of order
    folder = scratch(spark, "events")
    for n in range(0, 120, 40):
        part = late[n : n + 40] + late[max(0, n - 5) : n]  # some again
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp, value long").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, value long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet").withWatermark("ts", "30 hours")
    rules = [monitor.Range("high", -(10**9), 100), monitor.Range("band", -50, 300)]
    found = rows(replay.finished(monitor.watch(stream, rules, "2 hours"), "append"), "key", "rule", "action", "at", "cause")
    whole = spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, value long")
    until = whole.agg((F.date_trunc("millisecond", F.max("ts")) - F.expr("interval 30 hours")).alias("until"))
    assert found == rows(monitor.history(whole, rules, "2 hours", until), "key", "rule", "action", "at", "cause")
    by = collections.defaultdict(list)
    for key, rule, action, at, _ in sorted(found, key=lambda x: x[3]):
        by[key, rule].append(action)
    assert len(by) > 4 and all(a == ["raised", "cleared"] * (len(a) // 2) + ["raised"] * (len(a) % 2) for a in by.values())


@pytest.mark.parametrize("full", [512, 8])
def test_similar_vectors(spark, full):
    """Clusters at several angles: nine pairs of ten and more are found, none that is not one, and copies make none."""
    r = np.random.default_rng(7)
    rows_, n = [], 0
    for _ in range(60):
        center = r.standard_normal(32)
        for _ in range(r.integers(1, 6)):
            rows_.append((n, (center + r.standard_normal(32) * r.choice([0.05, 0.15, 0.25])).tolist()))
            n += 1
    rows_ += [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [1.0, None]), (5004, [1.0, 0.0]), (None, [1.0] * 32)]
    rows_ += [(6000 + k, [x * (k + 1) for x in rows_[0][1]]) for k in range(50)]  # of one direction
    close = r.standard_normal(32)
    rows_ += [(7000 + k, (close + r.standard_normal(32) * 1e-4).tolist()) for k in range(40)]
    pairs, members = similar.similar(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), 0.9, full=full)
    own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows_ if i is not None and v and i < 5000]
    want = {(i, j): float(a @ b) for (i, a), (j, b) in itertools.combinations(own, 2) if a @ b >= 0.9}
    found = {(p.a, p.b): p.cosine for p in pairs.collect()}
    usual = {k: c for k, c in found.items() if k[1] < 5000}
    assert set(usual) <= set(want) and len(usual) >= 0.9 * len(want) and all(abs(c - want[k]) < 1e-9 for k, c in usual.items())
    assert rows(members) == [(0, 6000 + k) for k in range(50)] and not any(6000 <= b < 7000 for _, b in found)
    cluster = {k for k in found if k[0] >= 7000}
    assert {b for _, b in cluster} == {7000 + k for k in range(1, 40)}  # each is linked to an earlier one, whether all pairs are told or not
    none, alone = similar.similar(spark.createDataFrame([], "vec_id long, embedding array<double>"), 0.9)
    assert none.collect() == alone.collect() == []


def test_covariance_and_simulated_loss(spark):
    r = np.random.default_rng(5)
    mix = r.standard_normal((6, 6))
    x = r.standard_normal((400, 6)) @ mix.T
    returns = spark.createDataFrame([(f"f{j}", i, float(x[i, j])) for i in range(400) for j in range(6) if not (j == 5 and i < 100)], "f string, d int, x double")
    for block in (2, 64):
        found = {(c.i, c.j): c.cov for c in risk.covariance(returns, "f", "d", "x", block).collect()}
        assert len(found) == 36
        for i, j in itertools.product(range(6), range(6)):
            a, b = (x[100:, i], x[100:, j]) if 5 in (i, j) else (x[:, i], x[:, j])
            assert abs(found[f"f{i}", f"f{j}"] - np.cov(a, b)[0, 1]) < 1e-9
    cov = risk.covariance(returns.filter("f <> 'f5'"), "f", "d", "x")
    exposures = spark.createDataFrame([(p, f"f{j}", float(r.standard_normal())) for p in range(300) for j in range(5)] + [(900, "f0", 1.0), (900, "f0", -1.0), (901, "other", 5.0)], "p int, f string, w double")
    exact = {s.p: s.sigma for s in risk.sigma(exposures, cov, "p", "f", "w").collect()}
    c = np.cov(x[:, :5].T)
    w = {p: np.zeros(5) for p in range(300)}
    for e in exposures.filter("p < 300").collect():
        w[e.p][int(e.f[1])] = e.w
    assert all(abs(exact[p] - np.sqrt(v @ c @ v)) < 1e-9 for p, v in w.items()) and exact[900] == 0
    found = {s.p: s for s in risk.simulate(exposures, cov, "p", "f", "w", 20_000).collect()}
    assert all(abs(found[p].var / exact[p] - 2.3263) < 0.12 and abs(found[p].es / exact[p] - 2.6652) < 0.14 for p in range(300))
    assert found[900].var == found[901].var == 0
    again = {s.p: s.var for s in risk.simulate(exposures.repartition(7), cov, "p", "f", "w", 20_000).collect()}
    assert all(abs(again[p] - found[p].var) < 1e-9 for p in found)  # whatever the partitions


def test_expected_exposure(spark):
    paths = spark.createDataFrame([(1, 1, 10.0, 20.0), (1, 2, 5.0, 20.0), (2, 1, -50.0, 1.0), (3, 1, 7.0, 0.0)], "k int, step int, m double, s double")
    found = {(e.k, e.step): e for e in risk.expected_exposure(paths, "k", "step", "m", "s", 50_000).collect()}
    phi, cdf = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi), lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
    held = lambda m, s: m * cdf(m / s) + s * phi(m / s)
    assert abs(found[1, 1].exposure - held(10, 20)) < 0.25 and abs(found[1, 2].exposure - held(15, 20 * math.sqrt(2))) < 0.4
    assert found[2, 1].exposure == 0 and found[3, 1].exposure == found[3, 1].peak == 7


def test_implied_volatility_reprices(spark):
    rows_ = [(float(f), float(k), t, v) for f in (50, 100) for k in (40, 90, 100, 130) for t in (0.1, 1.0, 5.0) for v in (0.05, 0.3, 1.5)]
    frame = spark.createDataFrame(rows_, "f double, k double, t double, v double").withColumn("d", F.exp(-0.02 * F.col("t")))
    args = [F.col(c) for c in ("f", "k", "t", "d")]
    for call in (True, False):
        priced = frame.withColumn("p", black(args[0], args[1], F.col("v"), args[2], args[3], call))
        found = priced.withColumn("x", derivatives.implied_vol(F.col("p"), *args, call=call)).withColumn("again", black(args[0], args[1], F.col("x"), args[2], args[3], call)).collect()
        assert all(abs(r.again - r.p) < 1e-6 for r in found if r.x is not None)
        assert all(abs(r.x - r.v) < 1e-4 for r in found if r.v >= 0.3 and r.t >= 1)
    out = frame.limit(1).withColumn("x", derivatives.implied_vol(F.lit(1e9), *args)).first()
    assert out.x is None


def test_surface_fits_and_tells_arbitrage(spark):
    k = [-0.2, -0.1, 0.0, 0.1, 0.2]
    w = lambda t, a, b, c: [("u", t, x, math.sqrt((a + b * x + c * x * x) / t)) for x in k]
    quotes = spark.createDataFrame(w(1.0, 0.04, -0.01, 0.1) + w(2.0, 0.03, 0.0, 0.2) + w(3.0, 0.2, 0.0, -1.5) + [("u", 9.0, 0.0, 0.2), ("u", 9.0, 0.1, 0.2)], "u string, t double, k double, v double")
    fitted = derivatives.surface(quotes, "u", "t", "k", "v")
    found = {r.t: (r.a, r.b, r.c) for r in fitted.collect()}
    assert set(found) == {1.0, 2.0, 3.0} and np.allclose(found[1.0], (0.04, -0.01, 0.1)) and np.allclose(found[2.0], (0.03, 0, 0.2)) and fitted.agg(F.max("error")).first()[0] < 1e-6
    told = rows(derivatives.arbitrage(fitted, "u", "t", [0.0, 0.1]), "t", "k", "kind")
    assert (2.0, 0.0, "calendar") in told and (3.0, 0.0, "butterfly") in told and not any(t == 1.0 for t, _, _ in told)


def test_compression_keeps_nets_and_takes_cycles_out(spark):
    r = random.Random(3)
    trades = [(g, r.choice("abcde"), r.choice("abcde"), r.randint(1, 50)) for g in range(6) for _ in range(30)] + [(9, "a", "b", 10), (9, "b", "c", 10), (9, "c", "a", 10), (8, "a", "b", 7), (8, "b", "c", 7), (7, "a", "a", 5)]
    found = rows(derivatives.compress(spark.createDataFrame(trades, "g int, p string, q string, n long"), ["g"], "p", "q", "n"), "g", "payer", "receiver", "notional")

    def nets(ts):
        out = collections.Counter()
        for g, p, q, n in ts:
            out[g, p] -= n
            out[g, q] += n
        return {k: v for k, v in out.items() if v}

    assert nets(found) == nets(trades)
    assert [f for f in found if f[0] >= 7] == [(8, "a", "c", 7)]
    for g in range(6):
        gross = sum(n for h, _, _, n in found if h == g)
        assert gross == sum(v for (h, _), v in nets(trades).items() if h == g and v > 0) <= sum(n for h, _, _, n in trades if h == g)
        assert sum(h == g for h, *_ in found) <= 4


def test_leg_cash_takes_the_fixing_before(spark):
    periods = spark.createDataFrame([(1, "x", day(10), day(100), 36_000_000, 5), (2, "x", day(5), day(95), 100, 0), (3, "y", day(10), day(20), 1, 1)], "id int, i string, s date, e date, n long, spread int")
    fixings = spark.createDataFrame([("x", day(5), 100), ("x", day(9), 295), ("x", day(10), 999)], "i string, f date, r int")
    found = derivatives.leg_cash(periods, fixings, ["i"], "s", "e", "n", "spread", "f", "r")
    assert rows(found, "id", "r", "cash") == [(1, 295, 36_000_000 * 300 * 90 // 3_600_000), (2, None, None), (3, None, None)]


def test_drawdown_spans_and_calmar(spark):
    levels = [100, 90, 80, 95, 100, 120, 110, 120, 60, 70]
    frame = spark.createDataFrame([("a", day(k), v) for k, v in enumerate(levels)] + [("b", day(0), 5), ("b", day(9), 7)], "k string, d date, v int")
    spans = performance.drawdown_spans(frame, ["k"], "d", "v").orderBy("start").collect()
    assert [(s.k, s.start, s.trough, s.recovery, round(s.depth, 9), s.days) for s in spans] == [("a", day(0), day(2), day(4), -0.2, 3), ("a", day(5), day(6), day(7), round(110 / 120 - 1, 9), 1), ("a", day(7), day(8), None, -0.5, 2)]
    found = {c.k: c for c in performance.calmar(frame, ["k"], "d", "v").collect()}
    assert abs(found["a"].calmar - ((0.7 ** (365 / 9) - 1) / 0.5)) < 1e-12 and found["b"].calmar is None and found["b"].yearly > 0


def test_capture_links_rates(spark):
    rates = [(0.1, 0.2), (-0.1, -0.05), (0.3, 0.1), (0.0, -0.2)]
    found = performance.capture(spark.createDataFrame([("k", r, m) for r, m in rates] + [("gone", -1.0, 0.1)], "k string, r double, m double"), ["k"], "r", "m", F.col("m") > 0)
    up, down = ((1.1 * 1.3) ** 0.5 - 1) / ((1.2 * 1.1) ** 0.5 - 1), (0.9**0.5 - 1) / ((0.95 * 0.8) ** 0.5 - 1)
    got = {c.k: (c.up, c.down) for c in found.collect()}
    assert np.allclose(got["k"], (up, down)) and got["gone"] == (None, None)


def test_regression_and_back_test(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal(60)
    y = 0.3 + 1.5 * x + 0.4 * r.standard_normal(60)
    a = np.column_stack([np.ones(60), x])
    coef, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    s2 = rss[0] / 58
    found = performance.regression(spark.createDataFrame([(1, float(p), float(q)) for p, q in zip(y, x, strict=True)] + [(2, 1.0, 1.0)], "k int, r double, m double"), ["k"], "r", "m").collect()
    assert len(found) == 1 and np.allclose([found[0].alpha, found[0].beta, found[0].alpha_t, found[0].appraisal], [*coef, coef[0] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0]), coef[0] / np.sqrt(s2)])
    days = spark.createDataFrame([(k, int(i < x)) for k, x in ((1, 10), (2, 0), (3, 100), (4, 5)) for i in range(100)], "k int, hit int")
    found = {d.k: d for d in performance.kupiec(days, ["k"], F.col("hit") == 1, 0.05).collect()}
    assert abs(found[1].statistic - 2 * (10 * math.log(0.1 / 0.05) + 90 * math.log(0.9 / 0.95))) < 1e-9 and found[1].rejected
    assert abs(found[2].statistic + 200 * math.log(0.95)) < 1e-9 and abs(found[3].statistic + 200 * math.log(0.05)) < 1e-9 and abs(found[4].statistic) < 1e-9 and not found[4].rejected


def test_effects_of_a_tree_add_up(spark):
    r = random.Random(4)
    leaves = [(a, f"{a}{b}", r.random(), r.uniform(-0.2, 0.3), r.random(), r.uniform(-0.2, 0.3)) for a in "xyz" for b in range(4)] + [("x", "only own", 0.3, 0.1, 0.0, 0.0)]
    w, b = sum(x[2] for x in leaves), sum(x[4] for x in leaves)
    leaves = [(*x[:2], x[2] / w, x[3], x[4] / b, x[5]) for x in leaves]
    found = performance.attribution_tree(spark.createDataFrame(leaves, "a string, b string, w double, r double, v double, s double"), ["a", "b"], "w", "r", "v", "s")
    assert found.filter("depth = 1").count() == 3 and found.filter("depth = 2").count() == 13
    total = found.agg(F.sum(F.col("allocation") + F.col("selection"))).first()[0]
    assert abs(total - (sum(x[2] * x[3] for x in leaves) - sum(x[4] * x[5] for x in leaves))) < 1e-12


def test_edits_of_many_pairs_are_those_of_each():
    r = random.Random(3)
    pairs = []
    for _ in range(3000):
        a = "".join(r.choice("abcd é") for _ in range(r.randint(0, 9)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            how = r.random()
            if how < 0.3:
                b.insert(k, r.choice("abcdeж😀"))
            elif how < 0.6:
                b[k : k + 1] = []
            else:
                b[k : k + 2] = b[k : k + 2][::-1]
        pairs.append((a, "".join(b)))
    assert screening.edits_of_pairs(*map(list, zip(*pairs, strict=True))).tolist() == [screening.edits(a, b) for a, b in pairs]
