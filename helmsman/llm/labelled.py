"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

MAX_LABELLED = 20_000  # rows a model is fitted on at most
MAX_BYTES = 64 << 20  # bytes of their texts at most
MAX_TEXT = 1 << 20  # longer texts are scored, but not learnt from


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of`` (null ids: 0)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % of, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use: Column, limit: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, label) of labelled rows that satisfy ``use``: in the order of a
    hash of id and text, at most ``limit`` rows whose texts before the last one hold
    less than ``max_bytes``, repeats counted.  The bounds hold after the join, however
    often an id repeats in either table; an id with several labels is learnt with each."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(use).distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit))  # at most ``limit`` pairs, 16 bytes each
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where("doc_id is not null").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TEXT)
             .withColumn("h", F.xxhash64("doc_id", "text")))
    met = texts.join(F.broadcast(ids), "doc_id")
    rows = (met.groupBy("doc_id", "label", "h").agg(F.count(F.lit(1)).alias("times"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
            .orderBy(F.xxhash64("doc_id", "h"), "doc_id", "label").limit(limit))
    order = Window.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "label")  # over at most ``limit`` rows
    rows = rows.withColumn("rows", F.sum("times").over(order) - F.col("times")).withColumn("bytes", F.sum(F.col("size") * F.col("times")).over(order) - F.col("size") * F.col("times"))
    times = F.least("times", F.lit(limit) - F.col("rows"), F.ceil((F.lit(max_bytes) - F.col("bytes")) / F.greatest("size", F.lit(1))))
    chosen = written(rows.where((F.col("rows") < limit) & (F.col("bytes") < max_bytes)).select("doc_id", "label", "h", times.cast("int").alias("times")), "labelled")
    once = texts.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "label", "h", "times").agg(F.first("text").alias("text"))
    return once.select("doc_id", F.explode(F.array_repeat(F.struct("text"), F.col("times"))).alias("t"), "label").select("doc_id", "t.text", "label")
