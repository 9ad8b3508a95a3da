"""Incremental index: new documents arrive as a stream, counts are merged batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.text import tokens


def term_counts(batch: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, df, cf) of one batch."""
    each = batch.select(F.col(doc).alias("doc"), F.explode(tokens(text)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def follow(stream: DataFrame, out: str, checkpoint: str, doc: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Appends each micro-batch's term counts below ``out`` under its batch id; a replayed batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        term_counts(batch.dropDuplicates([doc]), doc, text).write.mode("overwrite").parquet(os.path.join(out, f"batch={epoch}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """(term, df, cf) over all batches: document frequencies of disjoint batches add up."""
    return spark.read.parquet(out).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and tumbling window with a watermark; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
