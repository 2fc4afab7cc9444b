"""Registered retrieval queries: BM25 (K), vectors (V), fusion (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25
from ..sources import fixtures as fx
from . import sql_parts as S
from .registry import register


def _kb_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text")


@register("k4_bm25_topk", sql=f"""
WITH {S.BM25_INDEX}, {S.USER_QUESTIONS}, {S.bm25_scores('uq')}, {S.bm25_topk('bm25_sc', '5', 'top')}
SELECT query_id, doc_id, score, rank FROM top
""")
def k4_bm25_topk(spark, sf_dir):
    """Top 5 knowledge-base documents by BM25 for every user question."""
    index = bm25.build_index(_kb_docs(spark, sf_dir))
    return bm25.search(index, fx.user_questions(spark, sf_dir), k=5).select("query_id", "doc_id", "score", "rank")


@register("k2_bm25_idf", sql=f"""
WITH {S.BM25_INDEX}
SELECT term, df, round(idf, 6) AS idf FROM kb_idf
""")
def k2_bm25_idf(spark, sf_dir):
    """Term statistics with the IDF floor (negative IDF -> 0.25 x mean raw IDF)."""
    index = bm25.build_index(_kb_docs(spark, sf_dir))
    return index.terms.select("term", "df", r6("idf").alias("idf"))


@register("k1_bm25_postings", sql=f"""
WITH {S.BM25_INDEX}
SELECT p.doc_id, p.term, p.tf, d.dl FROM kb_post p JOIN kb_dl d USING (doc_id)
""")
def k1_bm25_postings(spark, sf_dir):
    """The inverted index: one row per (document, term) with tf and document length."""
    index = bm25.build_index(_kb_docs(spark, sf_dir))
    return index.postings.join(index.docs, "doc_id").select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@register("k3_bm25_scores", sql=f"""
WITH {S.BM25_INDEX}, {S.USER_QUESTIONS}, {S.bm25_scores('uq')}
SELECT query_id, doc_id, round(score, 6) AS score FROM bm25_sc
""")
def k3_bm25_scores(spark, sf_dir):
    """Every positive-or-not BM25 score of (user question, document) pairs sharing a term."""
    index = bm25.build_index(_kb_docs(spark, sf_dir))
    sc = bm25.scores(index, fx.user_questions(spark, sf_dir))
    return sc.select("query_id", "doc_id", r6("score").alias("score"))


@register("k7_bm25_doc_count", sql="""
SELECT count(*)::BIGINT AS n_docs, sum(CASE WHEN len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_empty
FROM documents
""")
def k7_bm25_doc_count(spark, sf_dir):
    """Indexed-document count; documents without tokens still count."""
    index = bm25.build_index(_kb_docs(spark, sf_dir))
    return index.docs.agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                          F.sum(F.when(F.col("dl") == 0, 1).otherwise(0)).cast("long").alias("n_empty"))


# ---------------------------------------------------------------- vectors
from ..functions import vectors as V  # noqa: E402
from ..operators import fusion, knn  # noqa: E402
from ..functions.numeric import r6


@register("v5_knn_topk", sql=f"""
WITH {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.knn_topk('vq', '10', 'nn')}
SELECT query_id, doc_id, score, rank FROM nn
""")
def v5_knn_topk(spark, sf_dir):
    """Exact cosine top-10 over active KB vectors for every vector question."""
    kb = fx.knowledge_base(spark, sf_dir)
    return knn.search(kb, fx.vector_questions(spark, sf_dir), k=10).select("query_id", "doc_id", "score", "rank")


@register("v6_knn_metadata_filter", sql=f"""
WITH {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.knn_topk('vq', '5', 'nn', "b.lang = 'en'")}
SELECT query_id, doc_id, score, rank FROM nn
""")
def v6_knn_metadata_filter(spark, sf_dir):
    """kNN restricted to KB rows whose metadata contains {lang: en}."""
    kb = fx.knowledge_base(spark, sf_dir)
    return knn.search(kb, fx.vector_questions(spark, sf_dir), k=5,
                      metadata_filter={"lang": "en"}).select("query_id", "doc_id", "score", "rank")


@register("v3_cosine_guarded", sql=f"""
WITH {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.knn_topk('vq', '3', 'nn')}
SELECT nn.query_id, nn.doc_id,
       round(list_dot_product(q.vector::DOUBLE[], b.embedding::DOUBLE[])
         / ((sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[])) + 1e-9)
            * (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9)), 6) AS similarity
FROM nn JOIN vq q ON q.query_id = nn.query_id JOIN kbv b ON b.doc_id = nn.doc_id
""")
def v3_cosine_guarded(spark, sf_dir):
    """Guarded cosine similarity of every question with its top-3 neighbours."""
    kb = fx.knowledge_base(spark, sf_dir)
    qs = fx.vector_questions(spark, sf_dir)
    hits = knn.search(kb, qs, k=3)
    j = (hits.join(qs.select("query_id", "vector"), "query_id")
         .join(kb.select(F.col("id").alias("doc_id"), "embedding"), "doc_id"))
    return j.select("query_id", "doc_id", r6(V.cosine_guarded("vector", "embedding")).alias("similarity"))


@register("v2_v4_vector_checks", sql="""
SELECT label, count(*)::BIGINT AS n,
       sum(CASE WHEN embedding IS NOT NULL AND len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS n_dim_ok,
       round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS avg_norm,
       round(avg(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 2))))), 6) AS avg_norm_after
FROM embeddings GROUP BY label
""")
def v2_v4_vector_checks(spark, sf_dir):
    """Dimension check (64) and L2 norms before/after normalisation, by label."""
    e = fx.table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(V.has_dimension("embedding", 64), 1).otherwise(0)).cast("long").alias("n_dim_ok"),
        r6(F.avg(V.norm("embedding"))).alias("avg_norm"),
        r6(F.avg(V.norm(V.l2_normalize("embedding")))).alias("avg_norm_after"),
    )


# ---------------------------------------------------------------- hybrid
def _hybrid(spark, sf_dir, fusion_method: str, k: int = 5):
    from ..config import HybridParams

    kb = fx.knowledge_base(spark, sf_dir)
    index = bm25.build_index(kb.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
    return fusion.search(index, kb, fx.vector_questions(spark, sf_dir),
                         HybridParams(fusion=fusion_method), top_k=k)


_HYBRID_SQL = f"""
WITH {S.BM25_INDEX}, {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.bm25_scores('vq')},
     {S.bm25_topk('bm25_sc', '10', 'bm')}, {S.knn_topk('vq', '10', 'nn')}, {{fuse}}, {S.fused_cut('fz', '5', 'hy')}
SELECT h.query_id, h.doc_id, h.combined_score, h.bm25_score, h.semantic_score, h.rank,
       coalesce(d.source || '/' || CAST(d.doc_id AS VARCHAR), '') AS title, length(coalesce(d.text, '')) AS content_chars
FROM hy h LEFT JOIN documents d ON d.doc_id = h.doc_id
"""


def _hybrid_out(df):
    return df.select("query_id", "doc_id", "combined_score", "bm25_score", "semantic_score", "rank", "title",
                     F.length("content").cast("long").alias("content_chars"))


@register("h2_hybrid_rrf", sql=_HYBRID_SQL.replace("{fuse}", S.rrf("bm", "nn", "fz")))
def h2_hybrid_rrf(spark, sf_dir):
    """Hybrid top-5 by reciprocal-rank fusion (2k fetched from each side)."""
    return _hybrid_out(_hybrid(spark, sf_dir, "rrf"))


@register("h3_hybrid_weighted", sql=_HYBRID_SQL.replace("{fuse}", S.weighted("bm", "nn", "fz")))
def h3_hybrid_weighted(spark, sf_dir):
    """Hybrid top-5 by weighted score fusion (BM25 scaled by the query's max)."""
    return _hybrid_out(_hybrid(spark, sf_dir, "weighted"))


@register("v6_variant_metadata_filter", sql="""
SELECT event_type, count(*)::BIGINT AS n_events,
       sum(CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 69 THEN 1 ELSE 0 END)::BIGINT AS n_matching
FROM events GROUP BY event_type
""")
def v6_variant_metadata_filter(spark, sf_dir):
    """Nested metadata containment: JSON props parsed to VARIANT and matched
    on a path ({"k": 69}), counted per event type."""
    ev = fx.table(spark, sf_dir, "events").select("event_type", F.parse_json("props").alias("meta"))
    hit = V.variant_contains("meta", {"k": 69})
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                        F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("n_matching"))


@register("a9_search_counters", sql=f"""
WITH {S.BM25_INDEX}, {S.USER_QUESTIONS}, {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.bm25_scores('uq')}, {S.bm25_topk('bm25_sc', '5', 'top')},
{S.knn_topk('vq', '5', 'nn')},
r AS (SELECT 'bm25' AS search_type, q.query_id, count(t.doc_id) AS results FROM uq q LEFT JOIN top t ON t.query_id = q.query_id GROUP BY 1, 2
      UNION ALL SELECT 'semantic', q.query_id, count(n.doc_id) FROM vq q LEFT JOIN nn n ON n.query_id = q.query_id GROUP BY 1, 2)
SELECT search_type, results::BIGINT AS results, count(*)::BIGINT AS searches FROM r GROUP BY 1, 2
""")
def a9_search_counters(spark, sf_dir):
    """Searches by type, with the histogram of results per query (top 5)."""
    index, kb = bm25.build_index(_kb_docs(spark, sf_dir)), fx.knowledge_base(spark, sf_dir)
    uq, vq = fx.user_questions(spark, sf_dir), fx.vector_questions(spark, sf_dir)
    out = None
    for kind, asked, hits in (("bm25", uq, bm25.search(index, uq, k=5)), ("semantic", vq, knn.search(kb, vq, 5))):
        n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        rows = asked.select("query_id").join(n, "query_id", "left").select(F.lit(kind).alias("search_type"), F.coalesce("n", F.lit(0).cast("long")).alias("results"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("search_type", "results").agg(F.count(F.lit(1)).alias("searches"))
