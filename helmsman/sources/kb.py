"""Knowledge-base maintenance as DataFrame jobs.

The KB is a snapshot table.  Every change produces a new DataFrame (and, when
written, a new snapshot directory); no job overwrites the path it reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import assign_ids

KB_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("embedding_model", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])


def read_articles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Bulk article source (title, content, metadata) with a fixed schema."""
    return spark.read.schema(ARTICLE_SCHEMA).format(fmt).load(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KB_SCHEMA).parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a new snapshot directory ``base/v=<version>`` (never the one being read)."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def ingest(kb: DataFrame, articles: DataFrame, as_of, order_col: str = "title", embedder=None,
           embedding_model: str | None = None) -> DataFrame:
    """S2 + S3: validated articles get ids after the current max id, in
    ``order_col`` order; null title -> '', null metadata -> {}; optional
    embedding plug-in (``DataFrame -> DataFrame`` adding ``embedding``)."""
    valid = articles.filter(F.col("content").isNotNull() & (F.length("content") >= 1))
    max_id = kb.agg(F.max("id")).first()[0] or 0
    ts = F.lit(as_of).cast("timestamp")
    rows = assign_ids(valid, [F.col(order_col).asc_nulls_first(), F.col("content").asc()], start=int(max_id) + 1)
    rows = rows.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), "content",
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    if embedder is not None:
        rows = embedder(rows)
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = rows.select(
        "id", "title", "content", "metadata", F.col("embedding").cast("array<float>").alias("embedding"),
        (F.lit(embedding_model) if embedding_model else F.lit(None)).cast("string").alias("embedding_model"),
        ts.alias("created_at"), ts.alias("updated_at"), F.lit(True).alias("is_active"))
    return rows


def active_documents(kb: DataFrame) -> DataFrame:
    """(id, content) of active rows."""
    return kb.filter(F.col("is_active")).select("id", "content")


def active_count(kb: DataFrame) -> DataFrame:
    """S5."""
    return kb.filter(F.col("is_active")).agg(F.count(F.lit(1)).alias("n_active"))


def update(kb: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """S6 + S7: per-column update by id (null update column keeps the old value);
    ``updated_at`` set on every touched row; unknown ids and updates that give
    nothing are ignored; of several updates of one id the last in the order of
    their JSON text is taken."""
    given = [c for c in ("content", "embedding", "metadata") if c in updates.columns]
    if not given:
        return kb
    some = reduce(lambda x, y: x | y, (F.col(c).isNotNull() for c in given))
    row = F.struct(*given)
    u = updates.filter(some).groupBy(F.col("id").alias("_uid")).agg(F.max_by(row, F.to_json(row)).alias("_u"))
    u = u.select("_uid", *[F.col(f"_u.{c}").alias(f"_u_{c}") for c in given])
    j = kb.join(u, kb.id == u._uid, "left")
    touched = F.col("_uid").isNotNull()
    cols = []
    for c in kb.columns:
        if f"_u_{c}" in j.columns:
            cols.append(F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(touched, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def soft_delete(kb: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """``is_active = false`` for the given ids."""
    k = ids.select(F.col("id").alias("_did")).distinct()
    j = kb.join(k, kb.id == k._did, "left")
    hit = F.col("_did").isNotNull()
    return j.select(*[F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active" else
                      (F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "updated_at"
                       else F.col(c)) for c in kb.columns])


def hard_delete(kb: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows removed."""
    return kb.join(ids.select("id"), "id", "left_anti")


def null_deleted_refs(retrievals: DataFrame, ids: DataFrame) -> DataFrame:
    """S9 (FK ON DELETE SET NULL): retrieval rows keep existing, kb_id nulled."""
    k = ids.select(F.col("id").alias("_did")).distinct()
    j = retrievals.join(k, retrievals.kb_id == k._did, "left")
    return j.select(*[F.when(F.col("_did").isNotNull(), F.lit(None).cast("long")).otherwise(F.col(c)).alias(c)
                      if c == "kb_id" else F.col(c) for c in retrievals.columns])


def cascade(children: DataFrame, ids: DataFrame, key: str = "query_id") -> DataFrame:
    """S9 (FK ON DELETE CASCADE): rows of a child table without those whose ``key`` is
    among the deleted ``ids``; a null key refers to nothing and stays."""
    return children.join(ids.select(F.col("id").alias(key)), key, "left_anti")
