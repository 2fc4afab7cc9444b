"""Hybrid retrieval: BM25 and vector hits fused per query.

Both inputs are already cut to ``2k`` hits per query (H1), so the full outer
join on ``(query_id, doc_id)`` and the final per-query ranking handle at most
``4k`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HybridParams
from . import bm25 as bm25_op
from . import knn as knn_op
from ..functions.numeric import r6


def rrf(bm25_hits: DataFrame, vec_hits: DataFrame, alpha: float, rrf_k: int = 60) -> DataFrame:
    """H2: alpha/(k + semantic_rank) + (1 - alpha)/(k + bm25_rank); a missing side scores 0.
    ``bm25_score``/``semantic_score`` hold the reciprocal ranks."""
    b = bm25_hits.select("query_id", "doc_id", F.col("rank").alias("b_rank"))
    v = vec_hits.select("query_id", "doc_id", F.col("rank").alias("v_rank"))
    j = b.join(v, ["query_id", "doc_id"], "full_outer")
    bs = F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("b_rank")), F.lit(0.0))
    vs = F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("v_rank")), F.lit(0.0))
    return j.select(
        "query_id", "doc_id",
        (F.lit(alpha) * vs + F.lit(1.0 - alpha) * bs).alias("combined_score"),
        bs.alias("bm25_score"), vs.alias("semantic_score"),
    )


def weighted(bm25_hits: DataFrame, vec_hits: DataFrame, alpha: float) -> DataFrame:
    """H3: alpha*cosine + (1 - alpha)*bm25/max_bm25 (max over this query's fetched
    hits; no division when the max is not positive)."""
    mx = F.max("score").over(Window.partitionBy("query_id"))
    b = (bm25_hits.withColumn("mx", mx)
         .select("query_id", "doc_id",
                 F.when(F.col("mx") > 0, F.col("score") / F.col("mx")).otherwise(F.col("score")).alias("b_norm")))
    v = vec_hits.select("query_id", "doc_id", F.col("score").alias("v_score"))
    j = b.join(v, ["query_id", "doc_id"], "full_outer")
    bs = F.coalesce("b_norm", F.lit(0.0))
    vs = F.coalesce("v_score", F.lit(0.0))
    return j.select(
        "query_id", "doc_id",
        (F.lit(alpha) * vs + F.lit(1.0 - alpha) * bs).alias("combined_score"),
        bs.alias("bm25_score"), vs.alias("semantic_score"),
    )


def cut(fused: DataFrame, k: int) -> DataFrame:
    """H5: rank by (rounded combined desc, doc_id asc) and keep k."""
    r = r6("combined_score")
    w = Window.partitionBy("query_id").orderBy(r.desc(), F.col("doc_id").asc())
    return (fused.withColumn("combined_score", r)
            .withColumn("bm25_score", r6("bm25_score"))
            .withColumn("semantic_score", r6("semantic_score"))
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def attach_documents(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """H4: title, content and metadata from the KB for every fused hit
    (BM25-only hits included; missing rows give '' '' {})."""
    docs = kb.select(F.col("id").alias("doc_id"), "title", "content", "metadata")
    out = hits.join(docs, "doc_id", "left")
    return out.select(
        *hits.columns,
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def search(index: bm25_op.Bm25Index, kb: DataFrame, queries: DataFrame, params: HybridParams | None = None,
           top_k: int | None = None, alpha: float | None = None, metadata_filter: dict | None = None,
           with_documents: bool = True, bm25_hits: DataFrame | None = None) -> DataFrame:
    """H6: hybrid search for every query row (query_id, text, vector).

    ``bm25_hits``: the best 2 ``top_k`` of these queries, where they have been searched
    already (without a filter).  Disabled, or a null or blank text -> no rows for the question, whether or not
    it has a vector."""
    p = params or HybridParams()
    if not p.enabled:
        more = ", title string, content string, metadata map<string,string>" if with_documents else ""
        return queries.sparkSession.createDataFrame(
            [], "query_id long, doc_id long, combined_score double, bm25_score double, "
                f"semantic_score double, rank long{more}")
    queries = queries.filter(F.length(F.trim("text")) > 0)
    k = top_k or p.top_k
    a = p.alpha if alpha is None else alpha
    fetch = 2 * k
    kb_active = kb.filter(F.col("is_active")) if "is_active" in kb.columns else kb
    allowed = None
    if metadata_filter:
        from ..functions.vectors import metadata_contains

        allowed = kb_active.filter(metadata_contains("metadata", metadata_filter)).select(F.col("id").alias("doc_id"))
    if bm25_hits is not None and not metadata_filter:  # blank texts have no hits
        bm_hits = bm25_hits
    else:
        bm_hits = bm25_op.search(index, queries, fetch, allowed_docs=allowed)
    vec_hits = knn_op.search(kb_active, queries.select("query_id", "vector"), fetch,
                             metadata_filter=metadata_filter, active_only=False)
    fused = rrf(bm_hits, vec_hits, a, p.rrf_k) if p.fusion == "rrf" else weighted(bm_hits, vec_hits, a)
    hits = cut(fused, k)
    return attach_documents(hits, kb) if with_documents else hits
