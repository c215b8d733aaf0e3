"""Resampling, line deduplication and lexical search against brute force, with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op11_resample, op12_lines, op13_lexical, words
from ledgerline.llm.common import forget

rng = random.Random(11)
POOL = ["alpha", "Beta", "gamma", "x9", "Größe", "été", "a", "the", "of", "日本", "zeta", "ETA", "don't", "42"]


def prose(n):
    return " ".join(rng.choice(POOL) + rng.choice(["", "", ",", "\n", " - "]) for _ in range(n))


COMMON = [f"Common line {k}" for k in range(4)]


def some_rows():
    out = []
    for k in range(70):
        lines = [prose(rng.randint(0, 12)) for _ in range(rng.randint(0, 6))] + [rng.choice(["", "\t", " "]) + rng.choice(COMMON) for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        out.append((k, "\n".join(lines)))
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "word " * 3000), (104, "\n".join(COMMON * 3)), (105, " Common line 0 "), (106, "COMMON LINE 1\r\n\x0bcommon line 2\x0c")]
    out += [(3, out[3][1]), (4, "Common line 3"), (None, "Common line 0\nx"), (None, "Common line 0\nx"), (None, "Common line 1"), (None, None), (-5, out[7][1])]
    return out


ROWS = some_rows()
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with what operators make."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "r") for i, t in ROWS], "doc_id long, text string, lang string, n_lines int, score int, _gone string")


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, prose(20)) for k in range(6)] + [(6, None), (7, "")], "item_id long, text string")


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def lines_by_brute_force(rows, least=10, chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add((i, t if i is None else ""))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if len(key(x)) < chars or len(holders[key(x)]) < least]
        out.append((i, len(own), len(own) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("least,chars", [(10, 1), (2, 1), (2, 9), (1, 1)])
def test_op12(docs, least, chars):
    found = op12_lines.deduplicate(docs, least, chars)
    want = lines_by_brute_force(ROWS, least, chars)
    assert got(found.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))) == sorted(want, key=repr)
    assert found.columns == ["doc_id", "text", "lang", "score", "_gone", "n_lines", "n_dropped"]
    assert any(n for _, _, n, _ in want)


def test_op12_null_text_stays_null_and_empty_tables_are_empty(docs):
    assert [r.text for r in op12_lines.deduplicate(docs).filter("doc_id = 100").collect()] == [None]
    assert op12_lines.deduplicate(docs.filter("false")).collect() == []


def test_op12_has_no_python_and_moves_texts_once(docs):
    plan = op12_lines.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert not re.search(r"Sort(?!MergeJoin)[^\n]*_row", plan)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled_by_brute_force(rows, target, percent, buckets=10_000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features_of(t))
    u = collections.Counter(bucket(f) for t in target for f in features_of(t))
    S, T = sum(s.values()) + buckets, sum(u.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((u[b] + 1) * S / ((s[b] + 1) * T)))
    out = []
    for i, t in rows:
        f = features_of(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(t)) >= least))
    enough = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = [(*x[:4], k + 1) for k, x in enumerate(enough[: percent * len(enough) // 100])]
    rest = enough[len(drawn) :] + [x for x in out if not x[4]]
    return sorted([*drawn, *((*x[:4], None) for x in rest)], key=repr)


@pytest.mark.parametrize("percent,buckets", [(25, 10_000), (100, 50), (0, 10_000)])
def test_op11(docs, target, percent, buckets):
    found = op11_resample.resample(docs, target, percent, buckets)
    assert got(found) == resampled_by_brute_force(ROWS, [r.text for r in target.collect()], percent, buckets)
    assert dict(found.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


def test_op11_empty_tables(docs, target):
    assert op11_resample.resample(docs.filter("false"), target).collect() == []
    assert got(op11_resample.resample(docs, target.filter("false"))) == resampled_by_brute_force(ROWS, [], 25)


def test_op11_a_task_starts_anew_when_its_tables_are_full():
    texts = [(t or "").encode() for _, t in ROWS]
    small, large = op11_resample.Features(100, most=40), op11_resample.Features(100)
    gains = np.arange(100) - 50
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        assert small.counts(part).tolist() == large.counts(part).tolist() == np.bincount([zlib.crc32(f.encode()) % 100 for t in part for f in features_of(t.decode())], minlength=100).tolist()
        a, b = small.sums(part, gains), large.sums(part, gains)
        assert [x.tolist() for x in a] == [x.tolist() for x in b] == [[len(features_of(t.decode())) for t in part], [sum(int(gains[zlib.crc32(f.encode()) % 100]) for f in features_of(t.decode())) for t in part]]


def test_words_of_a_long_text_come_in_pieces(monkeypatch):
    monkeypatch.setattr(words, "STEP", 10)
    for _, t in ROWS:
        assert [w.decode() for piece in words.words((t or "").encode()) for w in piece] == words_of(t)


def ranked_by_brute_force(rows, queries, k=10):
    docs = [(i, collections.Counter(w)) for i, t in rows if i is not None and (w := words_of(t))]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    items = collections.defaultdict(list)
    for i, t in queries:
        if i is not None:
            items[i] += words_of(t)
    out = []
    for item, terms in items.items():
        scored = []
        for i, c in docs:
            m = 100 - 75 + (75 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if df[t])
            scored += [(-score, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


QUERIES = [(k, prose(rng.randint(1, 30))) for k in range(9)] + [(20, None), (21, ""), (22, "nowhere unseen"), (23, "alpha alpha BETA"), (0, "zeta"), (None, "alpha")]


@pytest.mark.parametrize("sent,per_block,block,k", [(8 << 20, 512, 128, 10), (0, 2, 4, 3), (8 << 20, 3, 2, 10), (0, 512, 1, 100)])
def test_op13(spark, docs, monkeypatch, sent, per_block, block, k):
    monkeypatch.setattr(op13_lexical, "BLOCK", block)
    monkeypatch.setattr(op13_lexical, "SHARD", 9)
    shards = op13_lexical.index(docs)
    queries = spark.createDataFrame([(i, t, "x") for i, t in QUERIES], "item_id long, text string, term string")
    found = op13_lexical.search(shards, queries, k, per_block, sent)
    assert got(found) == ranked_by_brute_force(ROWS, QUERIES, k)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    forget(shards, found)


def test_op13_empty_tables(spark, docs, target):
    nothing = op13_lexical.index(docs.filter("false"))
    assert op13_lexical.search(nothing, target).collect() == []
    assert op13_lexical.search(op13_lexical.index(docs), target.filter("false")).collect() == []


def test_bounds_hold_and_blocks_are_left_out():
    r = random.Random(5)
    pool = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choice(pool[: 20 + k]) for _ in range(r.randint(1, 80))).encode() for k in range(380)]
    row = op13_lexical._shard(np.arange(380), texts)
    n, total = row["n_docs"], row["n_terms"]
    row |= {"terms": b"w3 w390 w200 w7"}
    tile = op13_lexical._Tile(row, n, total)
    col, weight = np.array([0, 1, 2, 3]), np.array([3, 900, 200, 2])
    order, bound = tile.blocks(col, weight)
    assert sorted(order.tolist()) == list(range(len(tile.block_docs) - 1)) and bound.tolist() == sorted(bound.tolist(), reverse=True)
    best = [int(tile.scores(b, col, weight)[1].max(initial=0)) for b in order]
    assert all(x <= y for x, y in zip(best, bound.tolist(), strict=True))
    assert bound[-1] < max(best)  # a block that need not be scored


def test_rows_of_op13_are_names_and_files_go_with_them(spark, docs):
    """However many shards a task goes through, what Spark hands it is no more than their names."""
    from ledgerline.llm.common import store

    shards = op13_lexical.index(docs)
    rows = shards.collect()
    assert sum(len(str(r)) for r in rows) < 400 * len(rows)
    held = {r["path"] for r in rows}
    assert all(op13_lexical._load(p)["vocab"] for p in held)
    forget(shards)
    assert not any(store(p)[0].get_file_info(store(p)[1]).is_file for p in held)
