"""A corpus from documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. What stages do with nulls, empty texts, ties and repeated rows is what
their operators state; here rows that share a doc_id are one document, which stays or goes as one, and a text that is cut
to nothing stays as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import op2_repeats, op3_jaccard, op5_pii, op7_rules, op9_packing
from ledgerline.llm.common import quoted, table, written


def _with_text_of(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars follows the text."""
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy 1 of the rule ledger keeps."""
    own = docs.withColumn("_row", F.struct(*map(quoted, docs.columns)))
    return op7_rules.apply(op7_rules.ledger(own, keep=["_row"])).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of documents that link by word shingles."""
    others = op3_jaccard.classes(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    # ids are hashed, so that texts are not sorted
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that stand earlier in the corpus."""
    return _with_text_of(op2_repeats.deduplicate(docs, report=False), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return _with_text_of(op5_pii.mask(docs, report=False), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return op9_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("private_data", private_data),
    ("packing", packing),
]

#: None: SQL has neither the tokenizer nor surrogates; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
