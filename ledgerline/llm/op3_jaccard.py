"""N-gram Jaccard join over a prefix tree of globally ordered shingle sets, and the components of its links.

1. Each group of documents counts in how many of its documents each shingle occurs; buckets of the hash space sum the
   groups' counts, and answer each group with the shingles that two or more documents have.
2. A set that links shares at least three quarters of its shingles, so sets that have fewer shared shingles have no
   link and end here. The others are ordered by (frequency class, hash), rarest first, which is one order for all.
3. Sets that are equal become one. Two sets can only link if they have a shingle in common among their first
   n - ceil(0.75 n) + 1 (the prefix): such a shingle is a candidate group.
4. Groups are joined without forming their pairs. A group's center is the set whose shingles are the most frequent, which
   is what copies were made of; in each round every set meets the center on which most of its groups agree, and groups
   whose sets are in one component are done. Groups that rounds leave, with those that share sets with them, are families;
   a family's sets outside its largest component are compared with all of it, in blocks.
5. Sets that meet the same set are a prefix tree in the order of frequent shingles first. It is walked in order; the
   overlap at each depth is kept, so that a set continues from the part that it has in common with the one before; as
   soon as what remains of both cannot reach the overlap that any set below would need, the walk goes on at the end of
   the subtree. Sets without a prefix key in common with the probe, and sets that a link has connected meanwhile, are
   passed over.

Links are those that connect: of sets that are in one component already no more links are looked for, so the number of a
document's links is not known. Entries of a hot shingle, rows of a hot text and pairs of a hot center are dealt over many
tasks by a salt.

Sets are 64-bit hashes: two different shingles of a pair of documents collide with a chance of about 1e-12 for sets of
1000. Results: a text without words has no set and is linked with nothing; with one to four words their sequence is its
shingle; a very long text is one set, held whole by the task that has it; equal texts are one set; centers, votes and
labels that tie go to the smaller id; rows of one doc_id are one document for components; a null doc_id has no component
and links nothing; other columns are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import frequent, grouped, known, mix, ordered, plan
from .common import SALTS, forget, spread_join, table, written
from .components import components

#: Words of a shingle, the similarity as a share of hundred, rounds against centers, and sets of a block.
WORDS, PERCENT, ROUNDS, FAMILY = 5, 75, 2, 256
#: Bytes of the sets of a run.
RUN_BYTES = 16 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NO_ID = np.iinfo(np.int64).min


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, ascending, and the bounds of each text's."""
    joined = np.frombuffer(b" " + b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    space = SPACE[joined]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    h, size = np.zeros(len(starts), np.uint64), ends - starts
    order = np.argsort(-size, kind="stable")
    counts = np.searchsorted(-size[order], -np.arange(1, 65), "right")
    for k, n in enumerate(counts.tolist()):
        if not n:
            break
        own = order[:n]
        h[own] = (h[own] ^ joined[starts[own] + k]) * np.uint64(0x9E3779B97F4A7C15)
        h[own] ^= h[own] >> np.uint64(32)
    for k in np.flatnonzero(size > 64).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(joined[starts[k] : ends[k]].tobytes(), digest_size=8).digest())
    h = mix(h ^ size.astype(np.uint64))
    bounds = np.searchsorted(starts, 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    n = max(0, len(h) - words + 1)
    wide = np.full(n, words, np.uint64)
    for k in range(words):
        wide = mix(wide * np.uint64(0xD6E8FEB86659FD93) + h[k : n + k])
    out, sizes = [], [0]
    for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if z - a >= words:
            own = np.unique(wide[a : z - words + 1])
        else:
            own = np.full(min(1, z - a), z - a, np.uint64)
            for k in range(a, z):
                own = mix(own * np.uint64(0xD6E8FEB86659FD93) + h[k])
        out.append(own)
        sizes.append(len(own))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(sizes)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The overlap that sets of n and m need: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of its rarest keys a set of n must show: sets that link have one of these in common."""
    return n - -(-percent * n // 100) + 1


SETS = "doc_id long, n_shingles long, digest binary, prefix int, tokens binary"


def sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row's set size and, of rows that may link, the ordered set: ascending keys of frequency class and hash."""
    groups, buckets = plan(docs)
    base = grouped(docs.select("doc_id", "text"), groups)

    def choose(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, _ = ordered(rows)
        h, bounds = shingles(texts)
        n = np.diff(bounds)
        df = known(h, answers, buckets)
        shared = np.add.reduceat(np.append(df > 1, 0), bounds[:-1]) * (n > 0) if len(n) else n
        out = []
        for k in range(len(ids)):
            row = (ids[k].item() if ids[k] != NO_ID else None, int(n[k]), None, None, None)
            if ids[k] != NO_ID and n[k] and 100 * int(shared[k]) >= percent * int(n[k]):
                own = slice(bounds[k], bounds[k + 1])
                level = np.minimum(63, 4 * np.log2(df[own].astype(np.float64))).astype(np.uint64)
                keys = np.sort(level << np.uint64(58) | h[own] >> np.uint64(6))
                prefix = prefix_length(int(n[k]), percent)
                once = int((level == 0).sum())  # no other document has these
                if once < prefix:
                    raw = keys.astype("<u8").tobytes()
                    row = (*row[:2], hashlib.blake2b(raw, digest_size=16).digest(), prefix, raw)
            out.append(row)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "digest", "prefix", "tokens"]) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("prefix", pa.int32()), ("tokens", pa.binary()))})

    return written(base.groupBy("g").cogroup(frequent(base, buckets, lambda texts: shingles(texts)[0]).groupBy("g")).applyInArrow(choose, SETS), "sets")


class PrefixTree:
    """Sets as descending keys in lexicographic order, which is the order of a walk through their prefix tree.

    ``shared[p]`` is the depth at which place p leaves the path of the place before it, and ``after[p]`` the next place
    that leaves it less deep: from a node of depth d at place p, the end of its subtree is found by following ``after``
    while ``shared`` is d or more.
    """

    STEP = 64

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT) -> None:
        """``sets`` are ascending keys."""
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda k: sets[k][::-1].astype(">u8").tobytes(), reverse=True)
        self.sets = [sets[k][::-1] for k in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.zeros(len(sets), np.int64)
        for p in range(1, len(self.sets)):
            x, y = self.sets[p - 1], self.sets[p]
            m = min(len(x), len(y))
            differ = x[:m] != y[:m]
            self.shared[p] = int(differ.argmax()) if differ.any() else m
        self.after, open_places = [len(sets)] * len(sets), []
        for p, depth in enumerate(self.shared.tolist()):
            while open_places and self.shared[open_places[-1]] > depth:
                self.after[open_places.pop()] = p
            open_places.append(p)
        # the rarest keys of each set, by key: sets that link have one of these in common
        heads = [s[::-1][: prefix_length(len(s), percent)] for s in self.sets]
        at = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        keys = np.concatenate(heads) if heads else np.empty(0, np.uint64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[by], at[by]

    def candidates(self, probe: np.ndarray) -> np.ndarray:
        """Places of the sets that have a prefix key in common with the probe and whose size allows a link."""
        head = probe[: prefix_length(len(probe), self.percent)]
        low, high = np.searchsorted(self.keys, head), np.searchsorted(self.keys, head, "right")
        met = np.zeros(len(self.sets), bool)
        for a, z in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
            met[self.places[a:z]] = True
        found = np.flatnonzero(met)
        sizes = self.sizes[found]
        return found[100 * np.minimum(sizes, len(probe)) >= self.percent * np.maximum(sizes, len(probe))]

    def join(self, probe: np.ndarray, places: np.ndarray | None = None, skip: Callable[[int], bool] = lambda k: False) -> Iterator[int]:
        """The numbers of the sets that link with the probe (ascending keys), of those at the places, less those to skip.

        The overlap at each depth of the path is kept, so a set goes on from what it has in common with the one before.
        At depth d with overlap o, when l keys of the probe can still follow, the best set below has d + l keys and the
        overlap o + l: if that is too little the subtree is left, and the walk goes on at its end.
        """
        todo = (self.candidates(probe) if places is None else places).tolist()
        m, overlap, last, barred = len(probe), np.zeros(1, np.int64), 0, 0
        for p in todo:
            if p < barred or skip(self.order[p]):
                continue
            own = self.sets[p]
            common = int(self.shared[last + 1 : p + 1].min()) if p > last else 0
            at = min(common, len(overlap) - 1)
            overlap, last = overlap[: at + 1], p
            need = least_overlap(len(own), m, self.percent)
            while True:
                left = int(np.searchsorted(probe, own[at - 1])) if at else m  # keys of the probe below the path's last
                reached = int(overlap[-1])
                if at < len(own) and reached + left < least_overlap(at + left, m, self.percent):
                    barred = self._end(p, at)
                    break
                if at == len(own) or reached + min(len(own) - at, left) < need:
                    break
                part = own[at : at + self.STEP]
                spots = np.minimum(np.searchsorted(probe, part), m - 1)
                overlap = np.concatenate([overlap, reached + np.cumsum(probe[spots] == part)])
                at += len(part)
            if at == len(own) and int(overlap[-1]) >= need:
                yield self.order[p]

    def _end(self, p: int, depth: int) -> int:
        """The first place after p that is not below p's node of a depth."""
        p += 1
        while p < len(self.after) and self.shared[p] >= depth:
            p = self.after[p]
        return p


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what pairs (center, rep) of set ids connect.

    A center's pairs are dealt by a salt over up to ``SALTS`` tasks; its set goes once to each of them, before the sets
    that meet it, which are taken in runs of at most 1000 sets and ``RUN_BYTES``. Of a run the linked sets and the center
    are linked with the least of them, so that no set has more than a run's links and one for each of its runs.
    """
    salted = pairs.select("center", "rep", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"))
    heads = salted.select("center", "salt").distinct().join(sets.select(F.col("rep").alias("center"), "tokens"), "center").select("center", "salt", F.lit(0).alias("kind"), F.col("center").alias("rep"), "tokens")
    others = salted.join(sets.select("rep", "tokens"), "rep").select("center", "salt", F.lit(1).alias("kind"), "rep", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        center, probe, size = None, np.empty(0, np.uint64), 0

        def close() -> pa.RecordBatch:
            tree = PrefixTree([s for _, s in held], percent)
            met = sorted([held[k][0] for k in tree.join(probe)] + [center])
            held.clear()
            return pa.record_batch([pa.array(met[:1] * (len(met) - 1), pa.int64()), pa.array(met[1:], pa.int64())], ["a", "b"])

        for batch in batches:
            for c, kind, rep, raw in zip(*(batch.column(n) for n in ("center", "kind", "rep", "tokens")), strict=True):
                own = np.frombuffer(raw.as_py(), "<u8")
                if held and (not kind.as_py() or len(held) == 1000 or size > RUN_BYTES):
                    yield close()
                    size = 0
                if kind.as_py():
                    held.append((rep.as_py(), own))
                    size += own.nbytes
                else:
                    center, probe = c.as_py(), own
        if held:
            yield close()

    dealt = heads.unionByName(others).repartition("center", "salt").sortWithinPartitions("center", "salt", "kind", "rep")
    return dealt.select("center", "kind", "rep", "tokens").mapInArrow(run, "a long, b long")


def _entries(sets: DataFrame) -> DataFrame:
    """token, rep and n of each prefix key that other documents have; central: the mean frequency class of the set's keys."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n, prefix, raw in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "prefix", "tokens")), strict=True):
                keys = np.frombuffer(raw, "<u8")
                level = keys >> np.uint64(58)
                keys = keys[:prefix][level[:prefix] > 0].astype(np.int64)
                columns = [keys, np.full(len(keys), rep), np.full(len(keys), n), np.full(len(keys), float(level.mean()))]
                yield pa.record_batch([pa.array(c) for c in columns], ["token", "rep", "n", "central"])

    return sets.select("rep", "n", "prefix", "tokens").mapInArrow(expand, "token long, rep long, n long, central double")


def links(sets: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """a, b: enough links between distinct sets (rep, n, prefix, tokens) to connect all that are connected, not each one."""
    spark = sets.sparkSession
    entries = written(_entries(sets), "entries")
    found = spark.createDataFrame([], "a long, b long")
    tried = spark.createDataFrame([], "center long, rep long")
    for turn in range(rounds + 1):
        if turn:
            labels = components(found)
            labelled = entries.select("token", "rep", "n", "central").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        else:
            labelled = entries.withColumn("label", F.col("rep"))
        middle = F.max(F.struct("central", (-F.col("rep")).alias("m"), "n", "label"))
        groups = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), middle.alias("c")).filter("low < high")
        groups = groups.select("token", (-F.col("c.m")).alias("center"), F.col("c.n").alias("c_n"), F.col("c.label").alias("c_label"))
        entries = written(spread_join(labelled, groups, "token", "rep"), "entries", entries)
        if turn:
            forget(labels)
        if entries.isEmpty():
            forget(entries)
            return found
        if turn == rounds:
            break
        met = entries.filter("label <> c_label").filter(_can_link("n", "c_n", percent))
        votes = met.groupBy("rep", "center").agg(F.count("*").alias("votes")).join(tried, ["center", "rep"], "left_anti")
        best = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("center")).alias("m"))).alias("b"))
        pairs = written(best.select((-F.col("b.m")).alias("center"), "rep"), "pairs")
        found = written(found.unionByName(_verified(pairs, sets, percent)), "found", found)
        tried = tried.unionByName(pairs)
    used: list[DataFrame] = []
    rest = written(found.unionByName(_families(entries, sets, percent, used)), "found", found)
    forget(entries, *used)
    return rest


MEMBER = "family long, rep long, label long, tokens binary"


def _families(entries: DataFrame, sets: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """The links that are left between components of groups, each family of groups that share sets compared in full.

    Sets of a family's largest component are not compared with each other, and sets only if they have a prefix key in
    common. Families of up to ``FAMILY`` sets are taken several at once, larger ones by blocks of sets against blocks of
    sets, so no task holds more than two blocks. ``used`` gets the tables that the result reads.
    """
    labels = entries.select("rep", "label").distinct()
    family = components(entries.select(F.col("rep").alias("a"), F.col("center").alias("b")))
    own = written(labels.join(family.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep"), "families", family)
    parts = own.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("family").agg(F.sum("n").alias("size"), (-F.max(F.struct("n", (-F.col("label")).alias("m")))["m"]).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    members = written(own.join(main, "family").join(sets.select("rep", "tokens"), "rep").select("family", "rep", "label", "main", "size", "tokens"), "members", own)
    used.append(members)
    few = members.filter(F.col("size") <= FAMILY)
    bins = max(1, -(-few.count() // FAMILY))
    small = few.withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins)).cast("int"))

    def small_families(rows: pa.Table) -> pa.Table:
        by: dict[int, list[int]] = {}
        for k, f in enumerate(rows.column("family").to_pylist()):
            by.setdefault(f, []).append(k)
        reps, label, main_of, raw = (rows.column(c).to_pylist() for c in ("rep", "label", "main", "tokens"))
        out: list[tuple[int, int]] = []
        for own in by.values():
            side = [(reps[k], label[k], np.frombuffer(raw[k], "<u8")) for k in own]
            out += _joined_blocks([x for x, k in zip(side, own, strict=True) if label[k] != main_of[k]], side, percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    found = small.groupBy("bin").applyInArrow(small_families, "a long, b long")
    large = members.filter(F.col("size") > FAMILY).withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / FAMILY)).cast("int"))
    if large.isEmpty():
        return found

    def pack(rows: pa.Table) -> pa.Table:
        raw = rows.column("tokens").to_pylist()
        return pa.table({"family": [rows.column("family")[0].as_py()], "size": rows.column("size")[:1], "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "reps": [rows.column("rep").to_pylist()], "labels": [rows.column("label").to_pylist()], "sets": pa.array([raw], pa.list_(pa.binary()))})

    kind = "family long, size long, block int, reps array<long>, labels array<long>, sets array<binary>"
    blocks = large.select("family", "size", "block", "rep", "label", "tokens").groupBy("family", "block").applyInArrow(pack, kind)
    probes = large.filter("label <> main").select("family", "size", "block", "rep", "label", "tokens").groupBy("family", "block").applyInArrow(pack, kind)
    # a probe block goes once to each block of its family, so that two blocks are a key of their own
    asked = probes.withColumn("b_block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / FAMILY) - 1).cast("int"))))
    met = asked.join(blocks.drop("size").toDF("family", "b_block", "b_reps", "b_labels", "b_sets"), ["family", "b_block"])

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                side = lambda p: [(i, x, np.frombuffer(t, "<u8")) for i, x, t in zip(r[p + "reps"], r[p + "labels"], r[p + "sets"], strict=True)]  # noqa: B023, E731
                out = _joined_blocks(side(""), side("b_"), percent)
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return found.unionByName(met.mapInArrow(block_pairs, "a long, b long"))


def _joined_blocks(probes: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of (rep, label, set) probes with members, as many as connect what was not connected yet."""
    tree, out = PrefixTree([keys for _, _, keys in members], percent), []
    label_of = np.array([members[k][1] for k in tree.order], np.int64)  # by place, as links join labels
    now: dict[int, int] = {}

    def top(x: int) -> int:
        while now.get(x, x) != x:
            x = now[x]
        return x

    place = np.empty(len(members), np.int64)
    place[tree.order] = np.arange(len(members))
    for rep, label, keys in probes:
        own = top(label)
        if (label_of == own).all():
            continue
        found = tree.candidates(keys)
        found = found[label_of[found] != own]
        for k in tree.join(keys, found, lambda k: label_of[place[k]] == own):  # noqa: B023
            other = int(label_of[place[k]])
            low, high = sorted((own, other))
            now[high] = low
            label_of[label_of == high] = low
            own = low
            out.append((rep, members[k][0]))
    return out


def _can_link(n: str, m: str, percent: int) -> F.Column:
    return 100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m))


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows = sets(docs, percent)
    equal = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "prefix", "tokens"), "doc_id").alias("s"))
    reps = written(equal.select("digest", "rep", "s.*"), "representatives")
    alike = components(links(reps.select("rep", "n", "prefix", "tokens"), percent).unionByName(_same_id(rows, reps)))
    labels = reps.select("digest", "rep").join(alike.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = spread_join(rows.select("doc_id", "n_shingles", "digest"), labels, "digest", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _same_id(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets of rows that have one id, of which there are none where ids are unique."""
    own = rows.filter("digest is not null").select("doc_id", "digest")
    several = own.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("d")).filter("least <> d").select("doc_id", "least")
    pairs = own.join(several, "doc_id").select("least", "digest").distinct()
    rep = reps.select("digest", "rep")
    return pairs.join(rep.withColumnRenamed("rep", "b"), "digest").join(rep.toDF("least", "a"), "least").select("a", "b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
