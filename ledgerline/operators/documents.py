"""Document search by an inverted index on disk, and links of documents to records of several kinds.

``build`` writes postings once: a row is a term's block of one document range, with the documents, the term's shares in
them, and the skip entries by which it can be passed over unread (first and last document, their number, largest share).
Blocks lie in folders by a hash of the term, in the order of the terms. Texts are dealt by range once; words are counted
and blocks made where a range lies. ``search`` reads the folders of the queries' terms only. It weighs their terms by the
number of documents in their blocks, adds up the largest impacts of each range, scores the ranges that promise most, and
of the rest only those whose bound reaches the k-th best score so far: all of it joins and aggregations. Blocks of the
queries' terms are dealt by range, so a document's score is summed, and a range's best are told, where the range lies.

Impacts are whole numbers, so sums don't depend on their order: a term's weight is the log of inverse document frequency
in thousandths, its share in a document grows with its count and falls with the document's length.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

#: Folders of an index; documents of a range, by numbers; ranges of each query that are scored first; words of a task.
FOLDERS, RANGE, FIRST, WORDS = 32, 256, 4, 2_000_000


def terms(text: Column) -> Column:
    """The words of a text with repeats: runs of ASCII letters, digits and all beyond ASCII, A to Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def folder(term: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index lies: postings by folder, and its documents' number and mean length at the time."""

    path: str
    n_docs: int
    n_terms: int
    folders: int

    def parts(self, spark: SparkSession) -> int:
        """In how many parts ranges are dealt."""
        return max(spark.sparkContext.defaultParallelism, math.ceil(self.n_terms / WORDS))

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folders: int = FOLDERS, width: int = RANGE) -> Index:
    """Writes an index below ``path``. Documents are numbers, one row each; those without a word are in no posting."""
    spark = docs.sparkSession
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sizes = own.select(F.size(terms(F.col("text"))).alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    index = Index(path, sizes["n"], sizes["l"], folders)
    # grouping by range and more needs no other shuffle than that by range
    dealt = own.withColumn("part", F.expr(f"doc div {width} - if(doc % {width} < 0, 1, 0)")).repartition(index.parts(spark), "part")
    words = dealt.select("part", "doc", terms(F.col("text")).alias("words")).select("part", "doc", F.size("words").alias("length"), "words")
    counts = words.select("part", "doc", "length", F.explode("words").alias("term")).groupBy("part", "term", "doc", "length").agg(F.count("*").alias("tf"))
    share = F.expr(f"(1000000 * tf) div (tf * 1000 + 8 * (25 + (75 * length * {sizes['n']}L) div {max(1, sizes['l'])}L))")
    blocks = counts.groupBy("part", "term").agg(F.array_sort(F.collect_list(F.struct("doc", share.alias("share")))).alias("entries"))
    skips = blocks.select("term", "part", F.col("entries")[0]["doc"].alias("first_doc"), F.element_at("entries", -1)["doc"].alias("last_doc"), F.size("entries").alias("docs"), F.array_max("entries.share").alias("most"), "entries", folder(F.col("term"), folders).alias("folder"))
    skips.sortWithinPartitions("folder", "term", "part").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    return index


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text", first: int = FIRST) -> DataFrame:
    """key, rank, doc, score: the k best documents of each query, equal scores by the smaller document."""
    asked = queries.filter(F.col(key).isNotNull()).select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("folder", folder(F.col("term"), index.folders)), "asked")
    some = [r["folder"] for r in asked.select("folder").distinct().collect()]  # as many as the index has folders
    postings = index.postings(spark).filter(F.col("folder").isin(some)).join(written(asked.select("folder", "term").distinct(), "terms"), ["folder", "term"], "left_semi")
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.sum("docs") + 1))).cast("long")
    weights = postings.groupBy("folder", "term").agg(weight.alias("w")).filter("w > 0")
    weighed = written(asked.join(weights, ["folder", "term"]).select(key, "folder", "term", (F.col("times") * F.col("w")).alias("factor")), "weighed")
    met = weighed.join(postings.select("folder", "term", "part", "most"), ["folder", "term"])  # without the entries
    bounds = written(met.groupBy(key, "part").agg(F.sum(F.col("factor") * F.col("most")).alias("bound")), "bounds")
    placed = bounds.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bound"), "part")))
    best, n = Window.partitionBy(key).orderBy(F.desc("score"), "doc"), index.parts(spark)

    def scored(parts: DataFrame, few: bool = False) -> DataFrame:
        """The k best documents of each range and query in it; of few ranges, blocks of others are left out before the shuffle."""
        wanted = written(parts.groupBy("part").agg(F.collect_set(key).alias("keys")), "wanted")
        blocks = postings.select("folder", "term", "part", "entries")
        dealt = (blocks.join(wanted.select("part"), "part", "left_semi") if few else blocks).repartition(n, "part")
        hits = dealt.join(wanted.repartition(n, "part"), "part").join(weighed, ["folder", "term"]).filter(F.array_contains("keys", F.col(key))).select("part", key, "factor", F.explode("entries").alias("e"))
        scores = hits.groupBy("part", key, F.col("e.doc").alias("doc")).agg(F.sum(F.col("factor") * F.col("e.share")).alias("score")).filter("score > 0")
        nth = F.row_number().over(Window.partitionBy("part", key).orderBy(F.desc("score"), "doc"))
        return scores.withColumn("nth", nth).filter(F.col("nth") <= k).select(key, "doc", "score")

    opened = written(scored(placed.filter(F.col("place") <= first), few=True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "opened")
    reached = opened.filter(F.col("rank") == k).select(key, F.col("score").alias("least"))
    rest = placed.filter(F.col("place") > first).join(reached, key, "left").filter("least is null or bound >= least")
    both = opened.drop("rank").unionByName(scored(rest).select(opened.drop("rank").columns))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(key, "rank", "doc", "score")


def resolve(links: DataFrame, targets: dict[str, DataFrame], kind: str = "target_type", key: str = "target_id", label: str = "label") -> DataFrame:
    """Links with the label of what they point to, told by their discriminator, and a state of each.

    ``targets`` gives, by discriminator, a frame of ``key`` and ``label`` with one row a key. A link whose discriminator is
    unknown is ``unknown_type``, one whose record is missing ``dangling``, one without a key ``empty``. The targets are one
    frame, so links are joined once, by discriminator and key together.
    """
    known = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias(kind), F.col(key).cast("string").alias(key), F.col(label).cast("string").alias(label)) for name, t in sorted(targets.items())])
    met = links.withColumn(key, F.col(key).cast("string")).join(known.withColumn("_there", F.lit(True)), [kind, key], "left")
    state = F.when(~F.coalesce(F.col(kind).isin(*targets), F.lit(False)), "unknown_type").when(F.col(key).isNull(), "empty").when(F.col("_there").isNull(), "dangling").otherwise("resolved")
    return met.withColumn("state", state).drop("_there")
