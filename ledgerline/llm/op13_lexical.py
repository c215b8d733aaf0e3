"""Ranked lexical search with block-max pruning over a forward index.

``index`` turns documents into shards, a file each and a row that names it: a vocabulary with document counts, and blocks of ``BLOCK`` documents in
ascending order of ids. A block has a forward index (of each document its terms and their numbers of occurrences) and, of
each of its terms, the most occurrences in a document and the least length of a document that has it. What the pair can
score at most is a bound for every document of the block, whatever else joins the corpus, so an index is never rewritten
as statistics change.

``search`` takes the corpus statistics from the index, and meets each shard with each block of queries. First, every shard
scores, of each query, the block with the highest bound; the k best of all shards give a threshold that k documents reach.
Then each shard goes through its other blocks in descending order of their bounds and ends where the bound is below the
threshold, which its own finds raise. Blocks whose bound equals the threshold are scored, as a smaller id wins a tie.

Shards are made where the documents are read; what is shuffled is a row a term and shard, and k rows a query and task.
Shards and packed blocks of queries are files, so that rows are names and a task holds one shard at a time, however many it
goes through; it keeps query blocks of at most ``SENT`` bytes. No list grows with the documents of a term.

Results: a null text or one without words scores nothing and is none of N; a very long text is a document of its block, which
it may fill alone; rows without a doc_id take no part; rows that repeat an id are documents each; rows of ``queries`` that
share an item_id are one item, whose terms are put together, and those without take no part; an item without terms, or
whose terms are in no document, has no rows; other columns are left out; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, forget, put, read_range, scratch, table, written
from .words import Dictionary, words

#: Results of a query; documents and entries of a block; documents and entries of a shard; queries of a block; bytes kept.
K, BLOCK, BLOCK_ENTRIES, SHARD, SHARD_ENTRIES, QUERIES, SENT = 10, 128, 1 << 16, 4096, 1 << 19, 512, 8 << 20
#: Shards of a task.
DEALT = 4
SHARDS = "path string, n_docs long, n_terms long"
#: Of a shard's file, besides vocab (terms with a space between). docs: ids, lengths and the n + 1 bounds of entries. blocks: bounds of documents and of maxima.
_KINDS = {"df": "<i4", "ids": "<i8", "lengths": "<i8", "bounds": "<i8", "term": "<u4", "tf": "<u4", "block_docs": "<i4", "block_bounds": "<i8", "block_term": "<u4", "block_tf": "<u4", "block_length": "<i8"}


def _shard(ids: np.ndarray, texts: list[bytes]) -> dict | None:
    """What a shard's file holds; None if no document has a term."""
    order = np.argsort(ids, kind="stable")
    vocab = Dictionary()
    numbers, at = vocab.numbers([texts[k] for k in order])
    lengths = np.diff(at)
    key, tf = np.unique((np.repeat(np.arange(len(ids)), lengths) << 32) | numbers, return_counts=True)
    has = lengths > 0
    doc = (np.cumsum(has) - 1)[key >> 32]  # documents without terms are left out
    ids, lengths, term = ids[order][has], lengths[has], key & 0xFFFFFFFF
    if not len(ids):
        return None
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
    starts = [0]
    for k in range(1, len(ids)):
        if k - starts[-1] >= BLOCK or bounds[k + 1] - bounds[starts[-1]] > BLOCK_ENTRIES:
            starts.append(k)
    block = np.searchsorted(starts, doc, "right") - 1
    by = np.argsort((block << 32) | term, kind="stable")
    both = ((block << 32) | term)[by]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    out = {
        "df": np.bincount(term, minlength=len(vocab)), "ids": ids, "lengths": lengths, "bounds": bounds, "term": term, "tf": tf, "block_docs": np.append(starts, len(ids)),
        "block_bounds": np.searchsorted(both[first] >> 32, np.arange(len(starts) + 1)), "block_term": both[first] & 0xFFFFFFFF,
        "block_tf": np.maximum.reduceat(tf[by], first), "block_length": np.minimum.reduceat(lengths[doc][by], first),
    }
    return {"n_docs": len(ids), "n_terms": int(lengths.sum()), "vocab": b" ".join(vocab)} | {c: x.astype(_KINDS[c]).tobytes() for c, x in out.items()}


def _save(path: str, row: dict) -> None:
    """The binary values of a row as a file of one compressed Arrow batch."""
    batch = pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.large_binary()) for c in row]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    put(path, sink.getvalue().to_pybytes())


def _load(path: str) -> dict:
    return pa.ipc.open_stream(read_range(path)).read_all().to_pylist()[0]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that name files, ``DEALT`` a task."""
    return rows.repartition(max(1, -(-rows.count() // DEALT)))


def index(docs: DataFrame) -> DataFrame:
    """The shards: files in the shared folder, and a table of their names."""
    base = scratch(docs.sparkSession, "shards")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, held, n = TaskContext.get().partitionId(), [], [], 0, 0

        def row() -> Iterator[pa.RecordBatch]:
            nonlocal n
            if ids and (made := _shard(np.array(ids, np.int64), texts)):
                path = f"{base}/{part}-{n}.arrow"
                _save(path, {c: made[c] for c in ("vocab", *_KINDS)})
                yield pa.record_batch([pa.array([path]), pa.array([made["n_docs"]]), pa.array([made["n_terms"]])], ["path", "n_docs", "n_terms"])
                n += 1
            ids.clear()
            texts.clear()

        for b in bounded(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), strict=True):
                if ids and (len(ids) >= SHARD or held + len(t or b"") // 6 > SHARD_ENTRIES):
                    yield from row()
                    held = 0
                ids.append(i)
                texts.append(t or b"")
                held += len(t or b"") // 6  # about the terms
        yield from row()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(build, SHARDS), "lexical", beside=base)


def _frequencies(shards: DataFrame) -> DataFrame:
    """term, df: the documents that hold each term of the corpus."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                row = _load(path)
                yield pa.record_batch([pa.array(row["vocab"].split(b" "), pa.binary()), pa.array(np.frombuffer(row["df"], "<i4").astype(np.int64))], ["term", "df"])

    return _dealt(shards.select("path")).mapInArrow(rows, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _terms(queries: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), strict=True):
                for piece in words(t):
                    yield pa.record_batch([pa.array([i] * len(piece), pa.int64()), pa.array(piece, pa.binary())], ["item_id", "term"])

    found = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").mapInArrow(rows, "item_id long, term binary")
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _packed(weights: DataFrame, blocks: int) -> DataFrame:
    """asked: the name of a file a block of queries, with the weights of its terms and the thresholds of its items."""
    base = scratch(weights.sparkSession, "packed")

    def pack(rows: pa.Table) -> pa.Table:
        items, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        terms = rows.column("term").combine_chunks().dictionary_encode()
        col = terms.indices.to_numpy()
        order = np.lexsort((col, item))
        least = np.zeros(len(items), np.int64)
        least[item] = rows.column("least").to_numpy()
        path = f"{base}/{rows.column('q')[0].as_py()}.arrow"
        _save(path, {
            "items": items.astype("<i8").tobytes(), "least": least.astype("<i8").tobytes(), "terms": b" ".join(terms.dictionary.to_pylist()), "col": col[order].astype("<i4").tobytes(),
            "weight": rows.column("weight").to_numpy()[order].astype("<i8").tobytes(), "item_bounds": np.searchsorted(item[order], np.arange(len(items) + 1)).astype("<i8").tobytes(),
        })
        return pa.table({"asked": [path]})

    packed = weights.withColumn("q", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("q").applyInArrow(pack, "asked string")
    return written(packed, "asked", beside=base)


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a score by its weight; it grows with tf and falls with the document's length."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * length * n) // total))


class _Tile:
    """A shard before a block of queries."""

    def __init__(self, row: dict, n: int, total: int) -> None:
        s = {c: np.frombuffer(row[c], kind).astype(np.int64) for c, kind in _KINDS.items() if c != "df"}
        of = {t: k for k, t in enumerate(row["terms"].split(b" "))}
        vocab = row["vocab"].split(b" ")
        col = np.fromiter((of.get(t, -1) for t in vocab), np.int64, len(vocab))
        self.ids, self.block_docs = s["ids"], s["block_docs"]
        used = col[s["term"]] >= 0  # entries of terms that no query has are left out
        self.bounds = np.concatenate([[0], np.cumsum(used)])[s["bounds"]]
        self.col = col[s["term"]][used]
        self.impact = impact(s["tf"][used], np.repeat(s["lengths"], np.diff(s["bounds"]))[used], n, total)
        self.most = np.zeros((len(self.block_docs) - 1, len(of)), np.int64)
        block, c = np.repeat(np.arange(len(self.block_docs) - 1), np.diff(s["block_bounds"])), col[s["block_term"]]
        self.most[block[c >= 0], c[c >= 0]] = impact(s["block_tf"], s["block_length"], n, total)[c >= 0]
        self.weight = np.zeros(len(of), np.int64)

    def blocks(self, col: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks in descending order of their bounds, and the bounds, for one query."""
        bound = self.most[:, col] @ weight
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def scores(self, block: int, col: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block with their scores, where above 0."""
        a, z = int(self.block_docs[block]), int(self.block_docs[block + 1])
        first, last = int(self.bounds[a]), int(self.bounds[z])
        self.weight[col] = weight
        running = np.concatenate([[0], np.cumsum(self.weight[self.col[first:last]] * self.impact[first:last])])
        self.weight[col] = 0
        own = running[self.bounds[a + 1 : z + 1] - first] - running[self.bounds[a:z] - first]
        at = np.flatnonzero(own)
        return self.ids[a + at], own[at]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _found(shards: DataFrame, asked: DataFrame, n: int, total: int, k: int, first: bool, sent: int) -> DataFrame:
    """item_id, doc_id, score: k rows at most of each query and shard, from the first block of each or from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand, shard, kept = None, {}, {}
        for b in batches:
            for path, block_of in sorted(zip(b.column("path").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                if path != at_hand:
                    at_hand, shard = path, _load(path)
                if block_of not in kept:
                    held = sum(len(x) for block in kept.values() for x in block.values())
                    kept = (kept if held <= sent else {}) | {block_of: _load(block_of)}
                row = shard | kept[block_of]
                tile = _Tile(row, n, total)
                items, least, at = (np.frombuffer(row[c], "<i8") for c in ("items", "least", "item_bounds"))
                cols, weights = np.frombuffer(row["col"], "<i4"), np.frombuffer(row["weight"], "<i8")
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, item in enumerate(items.tolist()):
                    col, weight = cols[at[q] : at[q + 1]], weights[at[q] : at[q + 1]]
                    order, bound = tile.blocks(col, weight)
                    ids, scores, bar = np.empty(0, np.int64), np.empty(0, np.int64), max(1, int(least[q]))
                    for block, most in zip(order[:1].tolist() if first else order[1:].tolist(), bound[:1].tolist() if first else bound[1:].tolist(), strict=True):
                        if most < bar:
                            break
                        more, own = tile.scores(block, col, weight)
                        keep = own >= bar
                        ids, scores = _best(np.concatenate([ids, more[keep]]), np.concatenate([scores, own[keep]]), k)
                        bar = max(bar, int(scores[-1])) if len(scores) == k else bar
                    if len(ids):
                        out.append((item, ids, scores))
                if out:
                    yield pa.record_batch([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], ["item_id", "doc_id", "score"])

    tiles = _dealt(shards.select("path")).crossJoin(F.broadcast(asked))
    return tiles.mapInArrow(run, "item_id long, doc_id long, score long")


def search(shards: DataFrame, queries: DataFrame, k: int = K, per_block: int = QUERIES, sent: int = SENT) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, by an index."""
    ranked = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    sums = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(1)).alias("total")).first()
    n, total = sums["n"], sums["total"]
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    # names of files tell nothing of the terms in them, so the size that would be broadcast is not known
    weights = written(_terms(queries).join(_frequencies(shards).hint("merge"), "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0"), "asked")
    blocks = max(1, -(-(weights.agg(F.count_distinct("item_id")).first()[0]) // per_block))

    asked = _packed(weights.withColumn("least", F.lit(0).cast("long")), blocks)
    some = written(_found(shards, asked, n, total, k, True, sent), "found")
    forget(asked)
    least = some.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
    asked = _packed(weights.join(least, "item_id", "left").fillna(0, ["least"]), blocks)
    rest = _found(shards, asked, n, total, k, False, sent)
    top = some.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = written(top, "ranked")
    forget(weights, asked, some)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = index(table(spark, sf_dir, "documents"))
    out = search(shards, table(spark, sf_dir, "benchmark"))
    forget(shards)
    return out


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as w from documents where doc_id is not null),
n as (select count(*) filter (where len(w) > 0) as n, sum(len(w))::bigint as l from d),
i as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark where item_id is not null) group by all),
e as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
q as (select i.*, cast(floor(1000 * ln((2.0::double * n + 2) / (2.0::double * df + 1))) as bigint) as weight from i join (select term, count(*) as df from e group by term) using (term), n),
s as (select item_id, r, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * n) // l)))) as bigint) as score from q join e using (term) join d using (r), n group by item_id, r),
o as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s join d using (r) where score > 0)
select item_id, rank, doc_id, score from o where rank <= {K}
"""
