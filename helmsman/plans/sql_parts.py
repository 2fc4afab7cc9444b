"""Reusable DuckDB CTE fragments for the oracle statements.

They restate, in SQL over the fixture views, the same views that
``helmsman.sources.fixtures`` builds, so each oracle reads the whole tables.
"""

# The BM25 index over the knowledge base (documents), k1 = 1.5, b = 0.75.
def bm25_index(source: str = "documents") -> str:
    """CTEs kb_tok, kb_dl, kb_stats, kb_post, kb_raw_idf, kb_idf over ``source`` (doc_id, text)."""
    return BM25_INDEX_TMPL.replace("{source}", source)


BM25_INDEX_TMPL = r"""
kb_tok AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda t: t <> '') AS toks
  FROM {source}
),
kb_dl AS (SELECT doc_id, len(toks) AS dl FROM kb_tok),
kb_stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM kb_dl),
kb_post AS MATERIALIZED (
  SELECT p.doc_id, p.term, p.tf,
         (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * d.dl / s.avgdl)) AS w
  FROM (SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest(toks) AS term FROM kb_tok) GROUP BY doc_id, term) p
  JOIN kb_dl d USING (doc_id) CROSS JOIN kb_stats s
),
kb_raw_idf AS MATERIALIZED (
  SELECT term, df, ln(s.n - df + 0.5) - ln(df + 0.5) AS raw_idf
  FROM (SELECT term, count(*) AS df FROM kb_post GROUP BY term) CROSS JOIN kb_stats s
),
kb_idf AS (
  SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * a.avg_idf ELSE raw_idf END AS idf
  FROM kb_raw_idf CROSS JOIN (SELECT avg(raw_idf) AS avg_idf FROM kb_raw_idf) a
)
"""

BM25_INDEX = bm25_index("documents")

# Query terms of every user question.
USER_QUESTIONS = r"""
uq AS (
  SELECT conv_id * 2147483648 + turn AS query_id, text, conv_id, turn
  FROM conversations WHERE role = 'user'
)
"""

# Every document with an embedding is a vector question.
VECTOR_QUESTIONS = r"""
vq AS (
  SELECT d.doc_id AS query_id, d.text, e.embedding AS vector
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
)
"""


def bm25_scores(questions: str, name: str = "bm25_sc") -> str:
    """CTEs ``{name}_qt`` and ``{name}`` with (query_id, doc_id, score)."""
    return rf"""
{name}_qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda t: t <> '')) AS term
        FROM {questions})
  GROUP BY query_id, term
),
{name} AS (
  SELECT q.query_id, p.doc_id, sum((q.qtf * i.idf) * p.w) AS score
  FROM {name}_qt q JOIN kb_idf i USING (term) JOIN kb_post p USING (term)
  GROUP BY q.query_id, p.doc_id
)
"""


def bm25_topk(scores: str, k: str, name: str) -> str:
    return rf"""
{name} AS (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id ASC)::BIGINT AS rank
  FROM {scores} WHERE score > 0
  QUALIFY rank <= {k}
)
"""

# Knowledge-base vectors (every document with an embedding; all rows active).
KB_VECTORS = r"""
kbv AS (
  SELECT d.doc_id, d.lang, d.source, e.embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
)
"""


def knn_topk(questions: str, k: str, name: str, where: str = "TRUE") -> str:
    """(query_id, doc_id, score, rank): exact cosine top-k of every question."""
    return rf"""
{name}_sim AS (
  SELECT q.query_id, b.doc_id,
         list_dot_product(q.vector::DOUBLE[], b.embedding::DOUBLE[])
           / (sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]))
              * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
  FROM {questions} q CROSS JOIN kbv b WHERE {where}
),
{name} AS (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id ASC)::BIGINT AS rank
  FROM {name}_sim
  QUALIFY rank <= {k}
)
"""


def fused_cut(fused: str, k: str, name: str) -> str:
    return rf"""
{name} AS (
  SELECT query_id, doc_id, round(combined_score, 6) AS combined_score,
         round(bm25_score, 6) AS bm25_score, round(semantic_score, 6) AS semantic_score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(combined_score, 6) DESC, doc_id ASC)::BIGINT AS rank
  FROM {fused}
  QUALIFY rank <= {k}
)
"""


def rrf(bm: str, vec: str, name: str, alpha: float = 0.5) -> str:
    return rf"""
{name} AS (
  SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id,
         {alpha} * coalesce(1.0 / (60.0 + v.rank), 0.0) + {1 - alpha} * coalesce(1.0 / (60.0 + b.rank), 0.0) AS combined_score,
         coalesce(1.0 / (60.0 + b.rank), 0.0) AS bm25_score,
         coalesce(1.0 / (60.0 + v.rank), 0.0) AS semantic_score
  FROM {bm} b FULL OUTER JOIN {vec} v ON b.query_id = v.query_id AND b.doc_id = v.doc_id
)
"""


def weighted(bm: str, vec: str, name: str, alpha: float = 0.5) -> str:
    return rf"""
{name}_b AS (
  SELECT query_id, doc_id,
         CASE WHEN max(score) OVER (PARTITION BY query_id) > 0
              THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END AS b_norm
  FROM {bm}
),
{name} AS (
  SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id,
         {alpha} * coalesce(v.score, 0.0) + {1 - alpha} * coalesce(b.b_norm, 0.0) AS combined_score,
         coalesce(b.b_norm, 0.0) AS bm25_score,
         coalesce(v.score, 0.0) AS semantic_score
  FROM {name}_b b FULL OUTER JOIN {vec} v ON b.query_id = v.query_id AND b.doc_id = v.doc_id
)
"""
