"""Sources and sinks: catalogues in JSON, graphs in CSV, text files by path, and the check of written files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model


def markdown_items(spark: SparkSession, path: str, kind: str, site: dict, pattern: str = r"\.md$") -> DataFrame:
    """One row a Markdown file below a path: id and title from the first heading, description, content and place."""
    return model._markdown_items(model.tree(spark, path), pattern, kind, site).drop("value")


def catalogue(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Items of a catalogue: a document with ``items``, or one item a line."""
    whole = spark.read.option("multiLine", "true")
    if schema is not None:
        whole = whole.schema(T.StructType([T.StructField("items", T.ArrayType(schema))]))
    return whole.json(path).select(F.inline("items"))


def write_catalogue(items: DataFrame, path: str, version: str, identity: dict | None = None, files: int | None = None) -> None:
    """JSON documents: version, identity, counts by type of all items, and items in the order of their ids.

    Each file of the folder is a whole document of a range of ids, whose names are in the order of the ids, so any reader of
    JSON takes a file, and ``catalogue`` all of them; ``files=1`` gives one. A document is written line by line: no task
    holds its items.
    """
    counts = {r["type"]: r["count"] for r in items.groupBy("type").count().collect()}  # a row a type
    opening = json.dumps({"modelVersion": version, "identity": identity or {}, "counts": dict(sorted(counts.items()))}, ensure_ascii=False)[:-1] + ', "items": ['

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda values: pa.record_batch([pa.array(values, pa.string())], ["value"])
        yield line([opening])
        comma = ""
        for b in batches:
            values = b.column("value").to_pylist()
            if values:
                yield line([comma + values[0], *("," + v for v in values[1:])])
                comma = ","
        yield line(["]}"])

    dealt = items.repartitionByRange(files, "id") if files else items.repartitionByRange("id")
    lines = dealt.sortWithinPartitions("id").select(F.to_json(F.struct(*items.columns)).alias("value"))
    lines.mapInArrow(document, "value string").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The items that ``write_catalogue`` wrote, with the columns of a model's items."""
    return catalogue(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in model.ITEM]))


def graph_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nodes or edges with a header; what is empty is an empty string, not null, where the column is a string."""
    return spark.read.option("header", "true").schema(schema).csv(path).na.fill("")


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path and state (missing, unexpected, changed) of files whose content is not what it should be, by their hashes."""
    a = expected.select("path", F.sha2("value", 256).alias("a"))
    b = found.select("path", F.sha2("value", 256).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")
