"""Exact removal of repeated passages by maximal repeats of an enhanced suffix array.

A passage of ``LENGTH`` bytes (a window) has one minimizer: the least hash of its ``GRAM``-byte strings. Windows next to
each other mostly share it, so a text is a row of runs of windows, each with a hash.

1. Groups of documents count their runs' hashes, buckets of the hash space sum them (as packed blocks) and answer which
   occur twice or more. Equal windows have equal minimizers, so runs whose hash occurs once hold no repeat.
2. The other runs' contexts, which are the bytes that their windows cover, go to the hash's bucket. A context that a
   group has twice goes once: the later ones are removed whole.
3. A bucket sorts its windows by a rolling hash. Where all equal windows have one byte before them, a longer repeat holds
   them. The rest, whose left extensions differ, are sorted as suffixes with common-prefix lengths, and a scan with a
   stack walks the tree of common-prefix intervals: each interval whose left extensions differ is a maximal repeat with
   all its occurrences, of which all but the earliest are removed. The longest repeat of an occurrence is told first.
4. Documents are met with their removed intervals.

Contexts of a hash that occurs ``HOT`` times or more are cut anew, by the least hash of their ``LONG``-byte strings in place
of ``GRAM``, so that what only shares a short string is dealt apart; they go the same way.

Texts move once: steps 1, 2 and 4 read one shuffle. Results: a null text is empty and, as all texts under 100 bytes,
keeps all bytes; a very long text is hashed in steps of ``STEP`` bytes, each with the bytes that its last windows cover, and
its runs are cut at ``WIDE`` windows; equal doc_ids are ordered by text, and repeated rows follow each other, so later
ones are removed; rows without an id come before all others, in one order that is the same in each run of as many rows; columns besides doc_id and text are kept by ``deduplicate``, whatever their names, but for those named
as the ones that ``report`` adds; no rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import BLOCK, blocks, frequent, grouped, known, mix, ordered, place, plan
from .common import quoted, table

#: Bytes of a passage and of the strings whose least hash stands for it; occurrences of a hash whose contexts are cut by
#: longer strings, and the bytes of those.
LENGTH, GRAM, HOT, LONG = 100, 32, 1024, 92
#: Bytes of text for which hashes are made at once (about 30 bytes of memory each), and windows of a run at most, which bounds
#: a context's bytes.
STEP, WIDE = 1 << 18, 128
#: Bytes of the corpus for each bucket, whose contexts are held and sorted at once.
BUCKET_BYTES = 1 << 20
B1 = np.uint64(0x9E3779B97F4A7C15)
U8 = np.uint64


def _rolling(buf: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``size`` bytes, by doubling and then joining the powers of two in size."""
    whole, have = None, 0
    h, step = buf.astype(np.uint64) + U8(1), 1
    while True:
        if size & step:
            if whole is None:
                whole, have = h, step
            else:
                n = len(buf) - have - step + 1
                whole, have = h[:n] * _power(base, have) + whole[step : step + n], have + step
        if step * 2 > size:
            return whole[: len(buf) - size + 1]
        n = len(h) - step
        h = h[:n] * _power(base, step) + h[step:]
        step *= 2


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first and last window start in the text, minimizer, and whether it stands there twice, of each run, in order."""
    out = []
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and held + len(texts[stop]) <= STEP:
            held += len(texts[stop])
            stop += 1
        if stop == at:  # a longer text, by steps of window starts
            for a in range(0, len(texts[at]) - length + 1, STEP):
                row, first, last, *rest = _runs([texts[at][a : a + STEP + length - 1]], at, length, gram)
                out.append((row, first + a, last + a, *rest))
            stop += 1
        elif held >= length:
            out.append(_runs(texts[at:stop], at, length, gram))
        at = stop
    kinds = (np.int64, np.int64, np.int64, np.uint64, bool)
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, kinds[k]) for k in range(5))


def _runs(texts: list[bytes], row: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    m, wide = mix(_rolling(buf, B1, gram)), length - gram + 1
    at, have = np.arange(len(m), dtype=np.int32), 1  # the first place of the least hash

    def least(shift: int) -> None:
        nonlocal m, at
        n = len(m) - shift
        later = m[shift:] < m[:n]
        m, at = np.where(later, m[shift:], m[:n]), np.where(later, at[shift:], at[:n])

    while have * 2 <= wide:
        least(have)
        have *= 2
    if have < wide:
        least(wide - have)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ok = np.zeros(len(m) + 1, np.int8)
    long = sizes >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, np.minimum(ends[long] - length + 1, len(m)), -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    new = ok.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
    new[starts[long]] = True  # a text that ends where another starts
    first = np.flatnonzero(new)
    of = np.searchsorted(ends, first, "right")
    last = np.minimum(np.append(first[1:], len(m)) - 1, ends[of] - length)
    if (last - first >= WIDE).any():  # long runs, where a text repeats itself closely, are cut
        n = (last - first) // WIDE + 1
        part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first, last, of = np.repeat(first, n) + part * WIDE, np.repeat(last, n), np.repeat(of, n)
        last = np.minimum(last, first + WIDE - 1)
    # least hashes are small numbers: mixed again they fill the buckets evenly
    return of + row, first - starts[of], last - starts[of], mix(m[first]), at[first] != at[last]


#: What a bucket gets, in the payload's first byte: contexts, or intervals that are known.
CONTEXTS, INTERVALS = b"C", b"I"
ENTRY = np.dtype([("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("size", "<u4")])
INTERVAL = np.dtype([("row", "<u4"), ("start", "<u4"), ("stop", "<u4")])


def _send(g: int, ids: np.ndarray, texts: list[bytes], answers: pa.Table, buckets: int, length: int, hot: int) -> pa.Table:
    """A group's contexts for the buckets."""
    row, first, last, m, _ = runs(texts, length)
    count = known(m, answers, buckets)
    some = np.flatnonzero(count > 1)
    by_bucket: dict[int, list[tuple]] = {}
    seen: set[bytes] = set()
    local: list[tuple] = []

    def deal(own: list[tuple], hashes: np.ndarray) -> None:
        for (r, a, context), b in zip(own, place(hashes, buckets)[0].tolist() if len(own) else [], strict=True):
            by_bucket.setdefault(b, []).append((r, a, context))

    def new(r: int, a: int, context: bytes) -> bool:
        if context in seen:  # rows and starts ascend, so this one is later
            local.append((r, a, a + len(context)))
            return False
        seen.add(context)
        return True

    spans = zip(row[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True)
    fresh = [(k, (r, a, context)) for k, (r, a, z) in zip(some.tolist(), spans, strict=True) if new(r, a, context := texts[r][a : z + length])]
    usual = [(k, own) for k, own in fresh if count[k] < hot]
    deal([own for _, own in usual], m[[k for k, _ in usual]] if usual else m[:0])
    fine = [own for k, own in fresh if count[k] >= hot]
    seen = set()
    of, start, stop, hashes, _ = runs([c for _, _, c in fine], length, min(LONG, length))
    parts = [(j, (fine[k][0], fine[k][1] + a, context)) for j, (k, a, z) in enumerate(zip(of.tolist(), start.tolist(), stop.tolist(), strict=True)) if new(fine[k][0], fine[k][1] + a, context := fine[k][2][a : z + length])]
    deal([own for _, own in parts], hashes[[j for j, _ in parts]] if parts else hashes[:0])
    where, payloads = [], []
    for b, own in by_bucket.items():
        entries = np.array([(ids[r], r, a, len(c)) for r, a, c in own], ENTRY)
        where.append(b)
        payloads.append(CONTEXTS + len(own).to_bytes(8, "little") + entries.tobytes() + b"".join([c for _, _, c in own]))
    if local:
        where.append(g % buckets)
        payloads.append(INTERVALS + np.array(_joined(*np.array(local, np.int64).T), INTERVAL).tobytes())
    return blocks(np.array(where, np.int64), g, payloads)


def _joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple]:
    """Intervals of each row with those that meet joined."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start, stop = row[order].astype(np.int64), start[order], stop[order]
    far = np.int64(1) << np.int64(33)
    reach = np.maximum.accumulate(row * far + stop)
    new = np.flatnonzero(np.append(True, row[1:] * far + start[1:] > reach[:-1]))
    ends = np.append(new[1:], len(row)) - 1
    return list(zip(row[new].tolist(), start[new].tolist(), (reach[ends] - row[ends] * far).tolist(), strict=True))


def maximal_repeats(text: bytes, ends: list[int], starts: list[int], left: list[int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Length and all occurrences of each maximal repeat among suffixes that start at ``starts`` and stop at ``ends``.

    ``left`` is the byte before each, or a number below zero of its own where nothing comes before.
    """
    order, lcp = _suffixes(text, ends, starts)
    return [(depth, [starts[k] for k in order[a:z]]) for depth, a, z in _groups(order, lcp, left, length)]


def _suffixes(text: bytes, ends: list[int], starts: list[int]) -> tuple[list[int], list[int]]:
    """The suffix array of the given suffixes, and the bytes that each has in common with the one before."""
    keys = [text[a:z] for a, z in zip(starts, ends, strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lcp = [0]
    for i, j in zip(order, order[1:], strict=False):
        a, b = keys[i], keys[j]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            low, n = 0, n - 1  # the first difference lies in low ... n
            while low < n:
                mid = (low + n + 1) // 2
                low, n = (mid, n) if a[:mid] == b[:mid] else (low, mid - 1)
        lcp.append(n)
    return order, lcp


def _groups(order: list[int], lcp: list[int], left: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """Depth and place in the suffix array (from, to) of each maximal repeat: deeper ones before those that hold them.

    Walks common-prefix intervals of at least ``length`` bottom up, and leaves out those with one byte before all.
    """
    changes = [0]  # of the byte before, up to each place
    for i, j in zip(order, order[1:], strict=False):
        changes.append(changes[-1] + (left[i] != left[j]))
    stack: list[tuple[int, int]] = []  # depth, first place
    for k in range(1, len(order) + 1):
        depth, start = lcp[k] if k < len(order) else 0, k - 1
        while stack and stack[-1][0] > depth:
            top, start = stack.pop()
            if changes[k - 1] > changes[start]:
                yield top, start, k
        if depth >= length and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def removed(entries: np.ndarray, text: bytes, length: int = LENGTH, groups: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Entry, start and size, within its context, of what repeats something earlier, from the maximal repeats of a bucket.

    ``groups`` are the groups of the entries, which order rows without an id.
    """
    g = np.zeros(len(entries), np.int64) if groups is None else groups
    sizes = entries["size"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    of = np.repeat(np.arange(len(entries)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pos = begin[of] + step
    buf = np.frombuffer(text, np.uint8)
    h = _rolling(buf, B1, length)[pos]
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
    width = np.diff(np.append(first, len(by)))
    before = np.where(step > 0, buf[np.maximum(pos - 1, 0)].astype(np.int64), -1 - of)[by]
    diverse = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) & (width > 1) if len(by) else np.empty(0, bool)
    chosen = by[np.repeat(diverse, width)]
    if not len(chosen):
        return []
    starts, own_of = pos[chosen].tolist(), of[chosen]
    left = np.where(step[chosen] > 0, buf[np.maximum(pos[chosen] - 1, 0)].astype(np.int64), -1 - own_of).tolist()
    ends = (begin[own_of] + sizes[own_of]).tolist()
    keys = list(zip(entries["doc"][own_of].tolist(), entries["row"][own_of].tolist(), g[own_of].tolist(), (entries["start"][own_of] + step[chosen]).tolist(), strict=True))
    order, lcp = _suffixes(text, ends, starts)
    rank = np.empty(len(keys), np.int64)  # of an occurrence in the corpus, by place in the suffix array
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    rank = rank[order]
    size = np.zeros(len(keys), np.int64)  # of the longest repeat in which an occurrence is not the earliest
    for depth, a, z in _groups(order, lcp, left, length):
        first = a + int(rank[a:z].argmin())
        own = size[first]
        np.maximum(size[a:z], depth, out=size[a:z])
        size[first] = own
    places, steps = own_of[order], step[chosen][order]
    some = np.flatnonzero(size)
    return list(zip(places[some].tolist(), steps[some].tolist(), size[some].tolist(), strict=True))


def _answer(rows: pa.Table, length: int) -> pa.Table:
    """A bucket's removed intervals for each group."""
    entries, texts, groups, out = [], [], [], {}
    for g, p in sorted(zip(rows.column("g").to_pylist(), rows.column("payload").to_pylist(), strict=True)):
        kind, body = p[:1], p[1:]
        if kind == CONTEXTS:
            n = int.from_bytes(body[:8], "little")
            entries.append(np.frombuffer(body, ENTRY, n, 8))
            texts.append(body[8 + n * ENTRY.itemsize :])
            groups.append(np.full(n, g))
        else:
            out.setdefault(g, []).extend(np.frombuffer(body, INTERVAL).tolist())
    if entries:
        e, g_of = np.concatenate(entries), np.concatenate(groups)
        for k, a, size in removed(e, b"".join(texts), length, g_of):
            start = int(e["start"][k]) + a
            out.setdefault(int(g_of[k]), []).append((int(e["row"][k]), start, start + size))
    bucket = rows.column("bucket")[0].as_py()
    payloads = []
    for spans in out.values():
        x = np.array(spans, np.int64)
        payloads.append(np.array(_joined(x[:, 0], x[:, 1], x[:, 2]), INTERVAL).tobytes())
    return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "g": pa.array(list(out), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _spans(rows: pa.Table, answers: pa.Table) -> tuple[np.ndarray, list[bytes], list[list[tuple[int, int]]]]:
    """Row numbers, texts and removed spans of a group's documents."""
    _, texts, order = ordered(rows)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if answers.num_rows:
        x = np.concatenate([np.frombuffer(p, INTERVAL) for p in answers.column("payload").to_pylist()])
        for r, a, z in _joined(x["row"], x["start"].astype(np.int64), x["stop"].astype(np.int64)):
            spans[r].append((a, z))
    return order, texts, spans


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join([text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)])


def _intervals(base: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    def hashes(texts: list[bytes]) -> np.ndarray:
        *_, m, twice = runs(texts, length)
        return np.concatenate([m, m[twice]])

    counted = frequent(base, buckets, hashes)

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return blocks(np.empty(0, np.int64), 0, [])
        ids, texts, _ = ordered(rows)
        return _send(rows.column("g")[0].as_py(), ids, texts, answers, buckets, length, hot)

    sent = base.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(send, BLOCK)
    return sent.groupBy("bucket").applyInArrow(lambda rows: _answer(rows, length), BLOCK)


def deduplicate(docs: DataFrame, length: int = LENGTH, hot: int = HOT, report: bool = True) -> DataFrame:
    """The same rows and columns with repeats cut out of ``text``; with ``report`` also n_bytes, n_removed, n_spans and kept_sha256.

    A cut may leave part of a character at its edges; such bytes go from ``text`` too, not from the digest.
    """
    groups, buckets = plan(docs, BUCKET_BYTES)
    own = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    own = own if report else []
    made = {f.name.lower() for f in own}
    kept_names = [c for c in docs.columns if c.lower() not in made]
    # the caller's columns travel under numbers, so that no name of theirs can meet one of these
    inner = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(kept_names)]
    docs = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(kept_names, inner, strict=True)])
    base = grouped(docs, groups)
    narrow = base.select("doc_id", "text", "g")
    schema = T.StructType([*docs.schema.fields, *own])

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        order, texts, spans = _spans(rows, answers)
        rows = rows.take(pa.array(order))
        rest = [kept(t, s) for t, s in zip(texts, spans, strict=True)]
        given = rows.column("text").is_null().to_pylist()
        new = {"text": [None if null else r.decode("utf-8", "ignore") for r, null in zip(rest, given, strict=True)]}
        if report:
            new |= {"n_bytes": [len(t) for t in texts], "n_removed": [sum(z - a for a, z in s) for s in spans], "n_spans": [len(s) for s in spans]}
            new["kept_sha256"] = [hashlib.sha256(r).hexdigest() for r in rest]
        kinds = to_arrow_schema(schema)
        return pa.table([pa.array(new[f.name], kinds.field(f.name).type) if f.name in new else rows.column(f.name).cast(kinds.field(f.name).type) for f in schema], names=schema.names)

    out = base.groupBy("g").cogroup(_intervals(narrow, buckets, length, hot).groupBy("g")).applyInArrow(cut, schema)
    return out.toDF(*kept_names, *(f.name for f in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return deduplicate(docs).drop("text")
