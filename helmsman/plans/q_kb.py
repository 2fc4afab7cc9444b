"""Registered KB-maintenance (S), re-indexing (K5-K8), cache (G6/G7) and
retrieval-evaluation (A20, A23, A26) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import HybridParams
from ..functions import text as T
from ..functions.numeric import r6
from ..operators import analytics as A
from ..operators import bm25, context, decision, fusion, knn
from ..sources import fixtures as fx
from ..sources import kb as KB
from ..sources import sinks
from . import sql_decision as SD
from . import sql_parts as S
from . import sql_text as Q
from .registry import register

CORRECTIONS_SQL = """
corr AS (
  SELECT conv_id AS id, text AS content FROM conversations WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
)
"""


def corrections(spark, sf_dir):
    """The latest assistant turn of each conversation is the agent's
    corrected answer for the KB document with the same id."""
    conv = fx.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    # max_by is a partial/final aggregate: a huge conversation is pre-reduced
    # in every task instead of being gathered for a window.
    return conv.groupBy("conv_id").agg(F.max_by("text", "turn").alias("content")).select(
        F.col("conv_id").alias("id"), "content")


@register("s1_kb_source", sql="""
SELECT d.doc_id AS id, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS title, length(d.text)::BIGINT AS content_chars,
       d.lang, d.source, e.vec_id IS NOT NULL AS has_vector, TRUE AS is_active
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""")
def s1_kb_source(spark, sf_dir):
    """The knowledge base as read from the source tables."""
    kb = fx.knowledge_base(spark, sf_dir)
    return kb.select("id", "title", F.length("content").cast("long").alias("content_chars"),
                     F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"),
                     F.col("embedding").isNotNull().alias("has_vector"), "is_active")


@register("s2_s3_ingest_pages", sql=f"""
SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY url ASC NULLS FIRST, c ASC) AS id,
       url AS title, length(c)::BIGINT AS content_chars
FROM (SELECT url, {Q.clean('html')} AS c FROM pages) WHERE length(c) >= 1
""")
def s2_s3_ingest_pages(spark, sf_dir):
    """Ingest every cleaned web page as a KB article: ids continue after the
    current maximum in title order (distributed numbering)."""
    kb = fx.knowledge_base(spark, sf_dir)
    pages = fx.table(spark, sf_dir, "pages")
    arts = pages.select(F.col("url").alias("title"), T.clean("html").alias("content"),
                        F.create_map(F.lit("source"), F.lit("web")).alias("metadata"))
    new = KB.ingest(kb, arts, fx.as_of(spark, sf_dir))
    return new.select("id", "title", F.length("content").cast("long").alias("content_chars"))


@register("s2_s3_ingest_documents", sql="""
SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY title ASC NULLS FIRST, text ASC) AS id,
       title, sha256(text) AS content_sha256, lang, source, n_chars
FROM (SELECT *, source || '/' || CAST(doc_id % 97 AS VARCHAR) AS title FROM documents) WHERE length(text) >= 1
QUALIFY count(*) OVER (PARTITION BY title, text) = 1
""")
def s2_s3_ingest_documents(spark, sf_dir):
    """Ingest every document again under a title that repeats, with its metadata
    map: dense unique ids over all columns.  Articles with equal title and text
    are numbered too, but are left out here, as SQL cannot tell them apart."""
    kb = fx.knowledge_base(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents")
    arts = docs.select(F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("title"), F.col("text").alias("content"),
                       F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string")).alias("metadata"))
    new = KB.ingest(kb, arts, fx.as_of(spark, sf_dir))
    twins = new.groupBy("title", "content").count().where("count > 1").drop("count")
    return new.join(twins, ["title", "content"], "left_anti").select(
        "id", "title", F.sha2("content", 256).alias("content_sha256"), F.col("metadata")["lang"].alias("lang"),
        F.col("metadata")["source"].alias("source"), F.col("metadata")["n_chars"].cast("long").alias("n_chars"))


@register("s8_s5_soft_delete_toxic", sql="""
SELECT d.lang, sum(CASE WHEN l.toxic = 1 THEN 0 ELSE 1 END)::BIGINT AS n_active,
       sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n_inactive
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang
""")
def s8_s5_soft_delete_toxic(spark, sf_dir):
    """Soft-delete every document labelled toxic; active/inactive counts by language."""
    kb = fx.knowledge_base(spark, sf_dir)
    toxic = fx.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    kb2 = KB.soft_delete(kb, toxic, fx.as_of(spark, sf_dir))
    return kb2.groupBy(F.col("metadata")["lang"].alias("lang")).agg(
        F.sum(F.when(F.col("is_active"), 1).otherwise(0)).cast("long").alias("n_active"),
        F.sum(F.when(F.col("is_active"), 0).otherwise(1)).cast("long").alias("n_inactive"))


@register("s6_s7_update_from_corrections", sql=f"""
WITH {CORRECTIONS_SQL}
SELECT d.doc_id AS id, length(coalesce(c.content, d.text))::BIGINT AS content_chars, c.id IS NOT NULL AS updated
FROM documents d LEFT JOIN corr c ON c.id = d.doc_id
""")
def s6_s7_update_from_corrections(spark, sf_dir):
    """Learning loop (A26): corrected answers replace KB content by id;
    ``updated_at`` moves on touched rows only."""
    kb = fx.knowledge_base(spark, sf_dir)
    t = fx.as_of(spark, sf_dir)
    kb2 = KB.update(kb, corrections(spark, sf_dir), t)
    return kb2.select("id", F.length("content").cast("long").alias("content_chars"),
                      (F.col("updated_at") == F.lit(t).cast("timestamp")).alias("updated"))


@register("k5_bm25_after_corrections", sql=f"""
WITH {CORRECTIONS_SQL},
upd AS (SELECT d.doc_id, coalesce(c.content, d.text) AS text FROM documents d LEFT JOIN corr c ON c.id = d.doc_id),
{S.bm25_index('upd')}, {S.USER_QUESTIONS}, {S.bm25_scores('uq')}, {S.bm25_topk('bm25_sc', '5', 'top')}
SELECT query_id, doc_id, score, rank FROM top
""")
def k5_bm25_after_corrections(spark, sf_dir):
    """Re-index after the corrections (kept postings + changed documents,
    statistics recomputed), then BM25 top-5 for every user question."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = bm25.build_index(docs)
    changed = corrections(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    index2 = bm25.update_documents(index, changed)
    index.release()  # the new index has its own postings
    return bm25.search(index2, fx.user_questions(spark, sf_dir), k=5).select("query_id", "doc_id", "score", "rank")


@register("k6_s9_remove_low_quality", sql=f"""
WITH keep AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
{S.bm25_index('keep')}
SELECT term, df, round(idf, 6) AS idf FROM kb_idf
""")
def k6_s9_remove_low_quality(spark, sf_dir):
    """Hard-delete low-quality documents from the KB and the BM25 index; the
    term statistics after removal."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = bm25.build_index(docs)
    low = fx.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select("doc_id")
    index2 = bm25.remove_documents(index, low)
    return index2.terms.select("term", "df", r6("idf").alias("idf"))


@register("k8_bm25_guards", sql=f"""
WITH {S.BM25_INDEX},
qs AS (SELECT conv_id * 2147483648 + turn AS query_id, text FROM conversations),
{S.bm25_scores('qs')}
SELECT qs.query_id, count(s.doc_id)::BIGINT AS n_matching
FROM qs LEFT JOIN bm25_sc s ON s.query_id = qs.query_id AND s.score > 0 GROUP BY qs.query_id
""")
def k8_bm25_guards(spark, sf_dir):
    """Number of documents with a positive BM25 score for every conversation
    turn (empty queries match nothing)."""
    index = bm25.build_index(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    conv = fx.table(spark, sf_dir, "conversations").select(
        fx.turn_id().alias("query_id"), "text")
    n = bm25.scores(index, conv, counted=True).withColumnRenamed("n", "n_matching")
    return conv.select("query_id").join(n, "query_id", "left").select(
        "query_id", F.coalesce("n_matching", F.lit(0)).cast("long").alias("n_matching"))


def _retrievals(spark, sf_dir):
    kb = fx.knowledge_base(spark, sf_dir)
    index = bm25.build_index(kb.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
    qs = fx.vector_questions(spark, sf_dir)
    b = bm25.search(index, qs, k=10).persist()  # k rows a question, fused as they are
    v = knn.search(kb, qs, k=10)
    h = fusion.search(index, kb, qs, HybridParams(fusion="weighted"), top_k=5, with_documents=False, bm25_hits=b)
    return qs, b, v, h


_RETR_SQL = (f"{S.BM25_INDEX}, {S.VECTOR_QUESTIONS}, {S.KB_VECTORS}, {S.bm25_scores('vq')}, "
             f"{S.bm25_topk('bm25_sc', '10', 'bm')}, {S.knn_topk('vq', '10', 'nn')}, {S.weighted('bm', 'nn', 'fz')}, "
             f"{S.fused_cut('fz', '5', 'hy')}")


@register("s12_retrieval_log", sql=f"""
WITH {_RETR_SQL}
SELECT query_id, doc_id AS kb_id, 'bm25' AS retrieval_method, score, rank FROM bm
UNION ALL SELECT query_id, doc_id, 'semantic', score, rank FROM nn
UNION ALL SELECT query_id, doc_id, 'hybrid', combined_score, rank FROM hy
""")
def s12_retrieval_log(spark, sf_dir):
    """Retrieval log: one row per (question, method, rank) for BM25, semantic and hybrid."""
    _, b, v, h = _retrievals(spark, sf_dir)
    return sinks.retrieval_log(b, v, h, fx.as_of(spark, sf_dir)).drop("created_at")


_REL = "(SELECT e.vec_id AS doc_id, e.label FROM embeddings e)"


@register("a20_precision_at_k", sql=f"""
WITH {_RETR_SQL},
lab AS {_REL},
hits AS (SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm UNION ALL SELECT 'semantic', query_id, doc_id, rank FROM nn
         UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hy)
SELECT method, round(avg(CASE WHEN ql.label = dl.label THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*)::BIGINT AS n_hits
FROM hits h JOIN lab ql ON ql.doc_id = h.query_id LEFT JOIN lab dl ON dl.doc_id = h.doc_id
WHERE h.rank <= 5 GROUP BY method
""")
def a20_precision_at_k(spark, sf_dir):
    """Precision@5 per retrieval method; a hit is relevant when its vector label
    equals the question's."""
    qs, b, v, h = _retrievals(spark, sf_dir)
    lab = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = (b.select(F.lit("bm25").alias("method"), "query_id", "doc_id", "rank")
            .unionByName(v.select(F.lit("semantic").alias("method"), "query_id", "doc_id", "rank"))
            .unionByName(h.select(F.lit("hybrid").alias("method"), "query_id", "doc_id", "rank")))
    rel = (hits.select("query_id", "doc_id").distinct()
           .join(lab.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
           .join(lab.select("doc_id", F.col("label").alias("dl")), "doc_id", "left")
           .select("query_id", "doc_id", (F.col("ql") == F.col("dl")).cast("int").alias("rel")))
    return A.precision_at_k(hits, rel, 5, "method")


@register("a23_threshold_sweep", sql=f"""
WITH {_RETR_SQL}, {SD.confidence('hy')},
lab AS {_REL},
top1 AS (SELECT h.query_id, CASE WHEN ql.label = dl.label THEN 1.0 ELSE 0.0 END AS correct
         FROM hy h JOIN lab ql ON ql.doc_id = h.query_id LEFT JOIN lab dl ON dl.doc_id = h.doc_id WHERE h.rank = 1),
s AS (SELECT vq.query_id, coalesce(conf.confidence, 0.0) AS c, coalesce(top1.correct, 0.0) AS correct
      FROM vq LEFT JOIN conf USING (query_id) LEFT JOIN top1 USING (query_id)),
t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS threshold)
SELECT t.threshold::DOUBLE AS threshold, round(avg(CASE WHEN s.c >= t.threshold THEN 1.0 ELSE 0.0 END), 6) AS auto_share,
       round(avg(CASE WHEN s.c >= t.threshold THEN s.correct END), 6) AS accuracy
FROM t CROSS JOIN s GROUP BY t.threshold
""")
def a23_threshold_sweep(spark, sf_dir):
    """Auto-answer share and top-1 accuracy of auto-answered questions for
    thresholds 0.3, 0.5, 0.7, 0.9 (conditional aggregates, no join)."""
    qs, _, _, h = _retrievals(spark, sf_dir)
    conf = decision.confidence(h, qs)
    lab = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    top1 = (h.filter(F.col("rank") == 1)
            .join(lab.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
            .join(lab.select("doc_id", F.col("label").alias("dl")), "doc_id", "left")
            .select("query_id", F.when(F.col("ql") == F.col("dl"), 1.0).otherwise(0.0).alias("correct")))
    s = conf.join(top1, "query_id", "left").select("confidence", F.coalesce("correct", F.lit(0.0)).alias("correct"))
    ts = (0.3, 0.5, 0.7, 0.9)
    aggs = []
    for i, t in enumerate(ts):
        auto = F.col("confidence") >= t
        aggs += [F.avg(F.when(auto, 1.0).otherwise(0.0)).alias(f"s{i}"), F.avg(F.when(auto, F.col("correct"))).alias(f"a{i}")]
    g = s.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), r6(F.col(f"s{i}")).alias("auto_share"),
                              r6(F.col(f"a{i}")).alias("accuracy")) for i, t in enumerate(ts)])
    return g.select(F.explode(rows).alias("r")).select("r.threshold", "r.auto_share", "r.accuracy")


@register("g6_cache_keys", sql=f"""
SELECT sha256({Q.clean('text')}) AS qhash, count(*)::BIGINT AS n_questions, min(conv_id * 2147483648 + turn) AS rep_id
FROM conversations WHERE role = 'user' GROUP BY 1
""")
def g6_cache_keys(spark, sf_dir):
    """Question cache keys: one retrieval per distinct cleaned question."""
    qs = fx.user_questions(spark, sf_dir).select("query_id", T.clean("text").alias("text"))
    unique, mapping = context.dedupe_for_cache(qs)
    n = mapping.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n_questions"))
    return (unique.select(F.col("query_id").alias("rep_id"), context.query_hash("text").alias("qhash"))
            .join(n, "rep_id").select("qhash", "n_questions", "rep_id"))


@register("g7_cache_invalidation", sql=f"""
WITH {_RETR_SQL}, {CORRECTIONS_SQL}
SELECT DISTINCT query_id FROM hy WHERE doc_id IN (SELECT id FROM corr)
""")
def g7_cache_invalidation(spark, sf_dir):
    """Cached answers to drop: questions whose hybrid hits include a corrected document."""
    _, _, _, h = _retrievals(spark, sf_dir)
    log = h.select("query_id", F.col("doc_id").alias("kb_id"))
    return context.invalidated_queries(log, corrections(spark, sf_dir))


@register("s10_s14_feedback_and_actions", sql="""
SELECT 'feedback' AS kind, CASE WHEN event_type = 'purchase' THEN 'thumbs_up' ELSE 'thumbs_down' END AS label,
       count(*)::BIGINT AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 2
UNION ALL
SELECT 'action', CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_type = 'error' THEN 'rejected'
                      WHEN event_type = 'click' THEN 'responded' ELSE 'assigned' END, count(*)::BIGINT FROM events GROUP BY 2
""")
def s10_s14_feedback_and_actions(spark, sf_dir):
    """Validated feedback rows and agent interactions as logged, counted by label."""
    ok, _bad = sinks.validated_feedback(fx.feedback_log(spark, sf_dir))
    f = ok.groupBy(F.col("feedback_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("feedback").alias("kind"), "label", "n")
    a = sinks.agent_interactions(spark, sf_dir).groupBy(F.col("action").alias("label")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("action").alias("kind"), "label", "n")
    return f.unionByName(a)


@register("s15_metrics_long", sql="""
WITH w AS (SELECT count(*) AS total_queries,
                  sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS auto_responses,
                  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS human_handoffs
           FROM events, (SELECT max(ts) AS t FROM events) r
           WHERE ts >= r.t - INTERVAL 86400 SECOND AND ts <= r.t)
SELECT 'total_queries' AS metric_name, total_queries::DOUBLE AS metric_value FROM w
UNION ALL SELECT 'auto_responses', auto_responses::DOUBLE FROM w
UNION ALL SELECT 'human_handoffs', human_handoffs::DOUBLE FROM w
""")
def s15_metrics_long(spark, sf_dir):
    """The 24-hour KPI counts as rows of the metrics table (unpivot)."""
    t = fx.as_of(spark, sf_dir)
    k = A.kpi(A.trailing(fx.request_log(spark, sf_dir), t, 24)).select("total_queries", "auto_responses", "human_handoffs")
    return sinks.metrics_long(k, t).select("metric_name", "metric_value")


@register("s4_active_scan_after_deletes", sql="""
SELECT doc_id AS id, length(text)::BIGINT AS content_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
""")
def s4_active_scan_after_deletes(spark, sf_dir):
    """Active (id, content) rows after soft-deleting toxic and hard-deleting
    low-quality documents."""
    kb = fx.knowledge_base(spark, sf_dir)
    labels = fx.table(spark, sf_dir, "labels")
    t = fx.as_of(spark, sf_dir)
    kb = KB.soft_delete(kb, labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id")), t)
    kb = KB.hard_delete(kb, labels.filter(F.col("quality") == 0).select(F.col("doc_id").alias("id")))
    return KB.active_documents(kb).select("id", F.length("content").cast("long").alias("content_chars"))


@register("s5_active_count", sql="""
SELECT count(*)::BIGINT AS n_active FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def s5_active_count(spark, sf_dir):
    """Active documents after the toxic ones were soft-deleted."""
    toxic = fx.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return KB.active_count(KB.soft_delete(fx.knowledge_base(spark, sf_dir), toxic, fx.as_of(spark, sf_dir)))


@register("s9_reference_effects", sql="""
WITH del AS (SELECT doc_id AS id FROM labels WHERE quality = 0),
r AS (SELECT event_id AS query_id, event_type, (props->>'k')::BIGINT AS kb_id FROM events)
SELECT event_type, count(*)::BIGINT AS n_retrievals, count(*) FILTER (kb_id NOT IN (SELECT id FROM del))::BIGINT AS n_references,
       count(*) FILTER (event_type IN ('purchase', 'error'))::BIGINT AS n_feedback
FROM r WHERE query_id NOT IN (SELECT id FROM del) GROUP BY 1
""")
def s9_reference_effects(spark, sf_dir):
    """Hard deletes and what refers to the deleted rows: deleted questions take their
    retrievals and feedback with them, deleted documents leave retrievals without a
    reference (every event is a question that retrieved the document its property names)."""
    gone = fx.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("id")).distinct()
    log = fx.request_log(spark, sf_dir).select("query_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("kb_id"))
    left = KB.null_deleted_refs(KB.cascade(log, gone), gone)
    feedback = KB.cascade(fx.feedback_log(spark, sf_dir), gone).select("query_id", F.lit(1).alias("f"))
    return left.join(feedback, "query_id", "left").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_retrievals"), F.count("kb_id").alias("n_references"), F.count("f").alias("n_feedback"))
