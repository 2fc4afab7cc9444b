"""Readers for the input tables and the views the jobs are defined over.

Every view here is a projection, filter or join of the given tables, so its
size grows with them.  The mapping is:

* knowledge base  = ``documents`` (id = doc_id, content = text, metadata = lang
  and source) left-joined to ``embeddings`` on ``vec_id = doc_id``;
* user questions  = every ``conversations`` turn with ``role = 'user'``
  (``query_id = conv_id * 2147483648 + turn``), whole text;
* vector questions = every document that has an embedding, whole text, with
  that embedding as its query vector;
* request log     = ``events`` (latency = value, handoff for ``error`` rows,
  confidence = value / 500);
* feedback        = ``events`` purchases (+1) and errors (-1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sf_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

EMBEDDING_MODEL = "fixture-64"
KB_CREATED_AT = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


TURNS = 1 << 31  # turns a conversation may have; one key per (conversation, turn)


def turn_id() -> Column:
    """The question id of a turn; a turn outside the key's range is an error."""
    inside = F.col("turn").between(0, TURNS - 1)
    return F.when(inside | F.col("turn").isNull(), F.col("conv_id") * TURNS + F.col("turn")).otherwise(
        F.raise_error(F.lit("a turn is outside 0 .. 2^31 - 1")).cast("long"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding), one vector per id: the smallest where an id repeats."""
    return (table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("id"))
            .agg(F.min("embedding").alias("embedding")))


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KB rows: id, title, content, metadata, embedding, embedding_model,
    created_at, updated_at, is_active."""
    docs = table(spark, sf_dir, "documents")
    # One vector per KB id (the id is the primary key).  Declaring it unique
    # lets Catalyst drop this join from plans that read no vector column (the
    # BM25 index build), and costs nothing where the join is needed: the
    # de-duplication and the join share the same partitioning by id.
    vecs = vectors(spark, sf_dir)
    created = F.to_timestamp(F.lit(KB_CREATED_AT))
    return (
        docs.select(
            F.col("doc_id").alias("id"),
            F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("title"),
            F.col("text").alias("content"),
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        )
        .join(vecs, "id", "left")
        .withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(EMBEDDING_MODEL)))
        .withColumn("created_at", created)
        .withColumn("updated_at", created)
        .withColumn("is_active", F.lit(True))
    )


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, conv_id, turn) for every user turn."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        turn_id().alias("query_id"),
        F.col("text"),
        F.col("conv_id"),
        F.col("turn"),
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, vector) for every document that has an embedding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = vectors(spark, sf_dir)
    return docs.join(vecs, docs.doc_id == vecs.id, "inner").select(
        F.col("doc_id").alias("query_id"), F.col("text"), F.col("embedding").alias("vector")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged query table: one row per event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("query_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit("human_handoff"))
        .otherwise(F.lit("auto_response"))
        .alias("routing_decision"),
        (F.col("value") / 500.0).alias("confidence_score"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("props"),
    )


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return ev.select(
        F.col("event_id").alias("feedback_id"),
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_type") == "purchase", F.lit("thumbs_up")).otherwise(F.lit("thumbs_down")).alias("feedback_type"),
        F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(-1)).alias("feedback_value"),
        F.col("user_id").cast("string").alias("agent_id"),
        F.col("ts").alias("created_at"),
    )


def as_of(spark: SparkSession, sf_dir: str):
    """The reference time of the logs: the latest event time (a scalar)."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
