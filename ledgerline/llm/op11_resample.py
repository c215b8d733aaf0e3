"""Importance resampling towards a target distribution, over hashed word n-grams.

Raw rows and target rows give counts of the features' buckets; a bucket's gain is the log ratio of the two smoothed
distributions, a document's weight the mean gain of its features, and the documents of highest weight plus Gumbel noise
are drawn, the noise being a hash of the id.

A task keeps an integer dictionary of the words it has met, so that a feature is one number or a pair of numbers. Distinct
tuples are found by sorting numbers; the bytes of a tuple are put together and hashed once in a task's life (the tables
start anew at ``MOST`` tuples, which bounds their memory), and counts are joined back by the tuple's place. Dictionaries
are of a task and not of the corpus: one of the corpus would move every distinct pair of words four times to save a hash of
some ten bytes. Tasks send a row a bucket, so a frequent feature is one number of a task; texts are never moved.

Features are runs of 1 to 2 words. Results: a null text, an empty one or one without words has no features and weight 0; a
very long text is held as one array of numbers; rows that share an id have the same noise and are documents each; rows
without an id have the noise of an empty id and come after others of equal score; rows that are equal in all columns get
ranks that follow each other; other columns are left out; without target rows, or without any rows, the counts are zero.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table, written
from .words import Dictionary

#: Buckets, percent of documents drawn, words that a document must have to be drawn, the seed, tuples that a task knows.
BUCKETS, PERCENT, LEAST_WORDS, SEED, MOST = 10_000, 25, 20, 7, 3_000_000


class Features:
    """The buckets of texts' features."""

    def __init__(self, buckets: int = BUCKETS, most: int = MOST) -> None:
        self.buckets, self.most = buckets, most
        self._start()

    def _start(self) -> None:
        self.number = Dictionary()
        self.words: list[bytes] = []
        self.single = np.empty(0, np.int64)
        self.prefix: list[int] = []
        self.pairs, self.double = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """Hashes words that are new, alone and with the space that stands before a second word."""
        new = list(itertools.islice(self.number, len(self.words), None))
        crc = [zlib.crc32(w) for w in new]
        self.words += new
        self.prefix += [zlib.crc32(b" ", c) for c in crc]
        self.single = np.concatenate([self.single, np.array(crc, np.int64) % self.buckets])

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        """Places of distinct, ascending pairs in the table of known pairs, of which new ones become part."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        new = pairs[self.pairs[at] != pairs] if len(self.pairs) else pairs
        if len(new):
            crc = np.array([zlib.crc32(self.words[b], self.prefix[a]) for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)], np.int64)
            to = np.searchsorted(self.pairs, new)
            self.pairs, self.double = np.insert(self.pairs, to, new), np.insert(self.double, to, crc % self.buckets)
            at = np.searchsorted(self.pairs, pairs)
        return at

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words and n + 1 bounds; distinct pairs' buckets, each pair's place among them, and n + 1 bounds."""
        if len(self.words) + len(self.pairs) > self.most:
            self._start()
        ids, bounds = self.number.numbers(texts)
        self._learn()
        within = np.ones(max(0, len(ids) - 1), bool)
        ends = bounds[1:-1]
        within[ends[(ends > 0) & (ends < len(ids))] - 1] = False
        pairs = ((ids[:-1] << 32) | ids[1:])[within]
        distinct, place = np.unique(pairs, return_inverse=True)
        sizes, at = np.diff(bounds), self._places(distinct)
        return self.single[ids], bounds, self.double[at], place, np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))])

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        single, _, double, place, _ = self.of(texts)
        return np.bincount(single, minlength=self.buckets) + np.bincount(double, weights=np.bincount(place, minlength=len(double)), minlength=self.buckets).astype(np.int64)

    def sums(self, texts: list[bytes | None], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text, and the sum of their gains."""
        single, bounds, double, place, pair_bounds = self.of(texts)
        total = lambda x, b: (c := np.concatenate([[0], np.cumsum(x)]))[b[1:]] - c[b[:-1]]
        return np.diff(bounds) + np.diff(pair_bounds), total(gains[single], bounds) + total(gains[double][place], pair_bounds)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Features(buckets), np.zeros(buckets, np.int64)
        for b in bounded(batches):
            n += found.counts(_texts(b))
        full = np.flatnonzero(n)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(n[full])], ["bucket", "n"])

    return rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, by the counts of both sides, of which a row a bucket comes to the driver at most."""

    def whole(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = whole(raw), whole(target)
    S, T = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * S / (float(a + 1) * T))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where a document is not drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(buckets)
        for b in bounded(batches):
            n, total = found.sums(_texts(b), gain)
            yield pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")
    # n words have 2 n - 1 features; the order is dealt by ranges, each of which is ranked for itself
    scored = weighed.select("*", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_features") < 2 * least - 1).alias("_short"))
    order = [F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    scored = written(scored, "scored")
    dealt = written(scored.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "drawn", instead=scored)
    every = Window.partitionBy()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.count(F.when(~F.col("_short"), 1)).alias("_long"))
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), (F.sum("_long").over(every) * percent).alias("_hundredfold"))
    ranked = dealt.join(F.broadcast(offsets), "_range").withColumn("rank", (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")).cast("long"))
    drawn = ~F.col("_short") & (F.col("rank") * 100 <= F.col("_hundredfold"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: crc32 byte by byte: a table of 256 numbers, and a fold over the bytes of each distinct feature.
SQL = f"""
with recursive crc(i, k, c) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from crc where k < 8),
tab as (select list(c order by i) as tab from crc where k = 8),
d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents), b as (select {_SPLIT} as w from benchmark),
fd as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
fb as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
nd as (select r, f, count(*) as n from fd group by all), nb as (select f, count(*) as n from fb group by all),
u as (select f, hex(encode(f)) as x from (select f from nd union select f from nb)),
h as (select f, cast(xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as bigint), 2) as bigint))),
        lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} as bigint) as bucket from u, tab),
s as (select bucket, sum(n) as n from nd join h using (f) group by 1), t as (select bucket, sum(n) as n from nb join h using (f) group by 1),
g as (select i as bucket, cast(floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * cast((select coalesce(sum(n), 0) from s) + {BUCKETS} as double)
        / (cast(coalesce(s.n, 0) + 1 as double) * cast((select coalesce(sum(n), 0) from t) + {BUCKETS} as double)))) as bigint) as gain
      from range({BUCKETS}) q(i) left join s on s.bucket = i left join t on t.bucket = i),
w as (select r, cast(sum(n) as bigint) as n_features, cast(floor(cast(sum(n * gain) as double) / cast(sum(n) as double)) as bigint) as weight from nd join h using (f) join g using (bucket) group by r),
a as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(d.w) < {LEAST_WORDS} as short,
        cast('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join w using (r)),
v as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from a),
o as (select *, row_number() over (order by short, score desc, doc_id nulls last, n_features, weight) as rank, count(*) filter (where not short) over () as n from v)
select doc_id, n_features, weight, score, case when not short and 100 * rank <= {PERCENT} * n then rank end as rank from o
"""
