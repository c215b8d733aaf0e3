"""Streaming forms of event operators; each gives on a finished stream what its batch form gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch


def events(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Events as a stream of files with a watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(frame: DataFrame, width: str = "1 hour") -> DataFrame:
    return frame.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sliding(frame: DataFrame, width: str = "6 hours", step: str = "3 hours") -> DataFrame:
    return frame.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(frame: DataFrame, gap: str = "2 hours") -> DataFrame:
    return frame.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(frame: DataFrame) -> DataFrame:
    return frame.dropDuplicates(["event_id", "ts"]) if frame.isStreaming else frame.dropDuplicates(["event_id"])


def positions(frame: DataFrame) -> DataFrame:
    """The running position of each user, in update mode on a stream."""
    return frame.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All rows that a stream of the files at hand gives, from a table in the shared folder, not from the driver's memory.

    Each micro-batch is written whole under its number; in complete mode the last batch is the result, in append mode all
    are, so a batch that runs again replaces itself.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "replay")
    kept: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{n}")
        kept.append(n)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    if not kept:
        return spark.createDataFrame([], stream.schema)
    parts = kept[-1:] if mode == "complete" else sorted(set(kept))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/{n}" for n in parts])


def alerts(frame: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Events beyond the limit of their kind, with the rule that they break; a stateless join, so each event is told once."""
    limit = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in limits.items()])
    value = F.round(F.col("value") * 100).cast("long")
    return frame.filter(value > limit).select("event_id", "user_id", F.concat(F.col("event_type"), F.lit(" above "), limit.cast("string")).alias("cause"), value.alias("v"))
