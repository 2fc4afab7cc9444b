"""Registered text-preparation queries: cleaning (P), PII (P9-P14),
validation (P16/P17), language (L) and subword tokens (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LangParams, PiiParams
from ..functions import pii
from ..functions import text as T
from ..operators import language
from ..sources import fixtures as fx
from . import sql_text as Q
from .registry import register


# ------------------------------------------------------------------ cleaning
@register("p1_strip_markup_pages", sql="""
SELECT page_id,
       regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'),
                      '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g'), '[*_`~]', '', 'g') AS stripped
FROM pages
""")
def p1_strip_markup_pages(spark, sf_dir):
    """HTML tags removed (replaced by nothing), markdown links to text, marks dropped."""
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_markup("html").alias("stripped"))


@register("p6_clean_documents", sql=f"""
SELECT doc_id, {Q.clean('text')} AS cleaned FROM documents
""")
def p6_clean_documents(spark, sf_dir):
    """Full cleaning (P1-P5 in order, then strip) of every document."""
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.clean("text").alias("cleaned"))


@register("p6_clean_pages", sql=f"""
SELECT page_id, {Q.clean('html')} AS cleaned FROM pages
""")
def p6_clean_pages(spark, sf_dir):
    """Full cleaning of raw web pages (tags, whitespace, punctuation runs)."""
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.clean("html").alias("cleaned"))


@register("p3_clean_lowercase_questions", sql=f"""
SELECT conv_id * 2147483648 + turn AS query_id, {Q.clean('text', lowercase=True)} AS cleaned
FROM conversations WHERE role = 'user'
""")
def p3_clean_lowercase_questions(spark, sf_dir):
    """Cleaning of every user question with the lowercase flag on."""
    from ..config import CleanParams

    qs = fx.user_questions(spark, sf_dir)
    return qs.select("query_id", T.clean("text", CleanParams(lowercase=True)).alias("cleaned"))


@register("p4_punctuation_runs", sql="""
SELECT doc_id, regexp_replace(text, '([!?.]){2,}', '\\1', 'g') AS collapsed FROM documents
""")
def p4_punctuation_runs(spark, sf_dir):
    """Runs of ! ? . collapsed to the last character of the run."""
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.collapse_punctuation("text").alias("collapsed"))


@register("p7_word_tokens", sql="""
SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_\\s]')) AS n_tokens,
       array_to_string(regexp_extract_all(text, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_\\s]'), ' ') AS tokens
FROM documents
""")
def p7_word_tokens(spark, sf_dir):
    """Word and punctuation tokens of every document."""
    docs = fx.table(spark, sf_dir, "documents")
    toks = T.word_tokens("text")
    return docs.select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                       F.array_join(toks, " ").alias("tokens"))


@register("p8_bm25_tokens", sql=f"""
SELECT conv_id * 2147483648 + turn AS query_id, len({Q.bm25_tokens('text')}) AS n_tokens,
       array_to_string({Q.bm25_tokens('text')}, '|') AS tokens
FROM conversations WHERE role = 'user'
""")
def p8_bm25_tokens(spark, sf_dir):
    """Lowercased whitespace tokens (punctuation kept) of every user question."""
    qs = fx.user_questions(spark, sf_dir)
    toks = T.bm25_tokens("text")
    return qs.select("query_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, "|").alias("tokens"))


@register("p18_model_input_length", sql="""
SELECT conv_id * 2147483648 + turn AS query_id, length(text) AS n_chars, length(substring(text, 1, 512)) AS model_chars
FROM conversations
""")
def p18_model_input_length(spark, sf_dir):
    """Characters of every turn and of its 512-character model input."""
    conv = fx.table(spark, sf_dir, "conversations")
    return conv.select(fx.turn_id().alias("query_id"),
                       F.length("text").cast("long").alias("n_chars"),
                       F.length(T.model_input("text")).cast("long").alias("model_chars"))


# ----------------------------------------------------------------------- PII
@register("p9_pii_counts", sql=f"""
SELECT doc_id,
       len({Q.matches('text', 'EMAIL_ADDRESS')}) AS n_email,
       len({Q.matches('text', 'PHONE_NUMBER')}) AS n_phone,
       len({Q.matches('text', 'CREDIT_CARD')}) AS n_card,
       len({Q.matches('text', 'SSN')}) AS n_ssn,
       len({Q.matches('text', 'PERSON')}) AS n_person
FROM documents
""")
def p9_pii_counts(spark, sf_dir):
    """Entity counts per document (cards must pass the Luhn check)."""
    docs = fx.table(spark, sf_dir, "documents")
    c = pii.counts("text")
    return docs.select("doc_id",
                       c["EMAIL_ADDRESS"].cast("long").alias("n_email"), c["PHONE_NUMBER"].cast("long").alias("n_phone"),
                       c["CREDIT_CARD"].cast("long").alias("n_card"), c["SSN"].cast("long").alias("n_ssn"),
                       c["PERSON"].cast("long").alias("n_person"))


@register("p9_pii_values", sql=f"""
SELECT doc_id, entity_type, value, count(*) AS n FROM (
  SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, unnest({Q.matches('text', 'EMAIL_ADDRESS')}) AS value FROM documents
  UNION ALL SELECT doc_id, 'CREDIT_CARD', unnest({Q.matches('text', 'CREDIT_CARD')}) FROM documents
  UNION ALL SELECT doc_id, 'SSN', unnest({Q.matches('text', 'SSN')}) FROM documents
  UNION ALL SELECT doc_id, 'PHONE_NUMBER', unnest({Q.matches('text', 'PHONE_NUMBER')}) FROM documents
  UNION ALL SELECT doc_id, 'PERSON', unnest({Q.matches('text', 'PERSON')}) FROM documents
) GROUP BY doc_id, entity_type, value
""")
def p9_pii_values(spark, sf_dir):
    """One row per (document, entity, value) with its number of occurrences."""
    docs = fx.table(spark, sf_dir, "documents")
    arr = F.array(*[F.struct(F.lit(e).alias("entity_type"), pii.matches("text", e).alias("vals"))
                    for e in pii.ORDER])
    ex = (docs.select("doc_id", F.explode(arr).alias("e"))
          .select("doc_id", F.col("e.entity_type").alias("entity_type"), F.explode("e.vals").alias("value")))
    return ex.groupBy("doc_id", "entity_type", "value").agg(F.count(F.lit(1)).alias("n"))


def _redact_query(strategy: str):
    params = PiiParams(strategy=strategy)

    def fn(spark, sf_dir):
        docs = fx.table(spark, sf_dir, "documents")
        return docs.select("doc_id", pii.redact("text", params).alias("redacted"))

    return fn


for _strategy, _key in (("replace", "p10_redact_replace"), ("mask", "p11_redact_mask"),
                        ("hash", "p12_redact_hash"), ("drop", "p13_redact_unknown_strategy")):
    register(_key, sql=f"WITH {Q.redaction_ctes('documents', 'doc_id', 'text', PiiParams(strategy=_strategy))} "
                       "SELECT doc_id, redacted FROM pii_redacted")(_redact_query(_strategy))


@register("p14_has_pii", sql=f"""
SELECT d.lang, count(*) AS n_docs,
       sum(CASE WHEN len({Q.matches('text', 'EMAIL_ADDRESS')}) + len({Q.matches('text', 'CREDIT_CARD')})
                   + len({Q.matches('text', 'SSN')}) + len({Q.matches('text', 'PHONE_NUMBER')})
                   + len({Q.matches('text', 'PERSON')}) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_with_pii
FROM documents d GROUP BY d.lang
""")
def p14_has_pii(spark, sf_dir):
    """Documents with any PII, by language label."""
    docs = fx.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                    F.sum(F.when(pii.has_pii("text"), 1).otherwise(0)).cast("long").alias("n_with_pii"))


@register("p9_pii_spans", sql=f"WITH {Q.redaction_ctes('documents', 'doc_id', 'text')} "
          'SELECT doc_id, entity_type, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(1.0 AS DOUBLE) AS score FROM pii_spans')
def p9_pii_spans(spark, sf_dir):
    """Span offsets of every entity in every document."""
    docs = fx.table(spark, sf_dir, "documents")
    return (docs.select("doc_id", F.explode(pii.spans("text")).alias("s"))
            .select("doc_id", "s.entity_type", "s.start", "s.end", "s.score"))



# ---------------------------------------------------------------- validation
@register("p16_validate_questions", sql="""
SELECT conv_id * 2147483648 + turn AS query_id,
       (text IS NOT NULL AND length(text) >= 1) AS is_valid,
       CASE WHEN text IS NULL THEN 'text_null' WHEN length(text) < 1 THEN 'text_empty' END AS reject_reason
FROM conversations
""")
def p16_validate_questions(spark, sf_dir):
    """Request validation of every conversation turn (text present and non-empty)."""
    conv = fx.table(spark, sf_dir, "conversations")
    ok, why = T.validate_query("text")
    return conv.select(fx.turn_id().alias("query_id"), ok.alias("is_valid"),
                       why.alias("reject_reason"))


@register("p17_batch_split", sql=f"""
SELECT role, count(*) AS n_total,
       sum(CASE WHEN text IS NOT NULL AND length({Q.clean('text')}) >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_ok,
       sum(CASE WHEN text IS NULL OR length({Q.clean('text')}) < 1 THEN 1 ELSE 0 END)::BIGINT AS n_rejected
FROM conversations GROUP BY role
""")
def p17_batch_split(spark, sf_dir):
    """Batch preparation: rows whose text is missing or cleans to '' are
    quarantined, the rest continue; counts per role."""
    from ..plans.prep import split_valid

    conv = fx.table(spark, sf_dir, "conversations")
    good, bad = split_valid(conv, "text")
    g = good.groupBy("role").agg(F.count(F.lit(1)).alias("n_ok"))
    b = bad.groupBy("role").agg(F.count(F.lit(1)).alias("n_rejected"))
    tot = conv.groupBy("role").agg(F.count(F.lit(1)).alias("n_total"))
    return (tot.join(g, "role", "left").join(b, "role", "left")
            .select("role", "n_total", F.coalesce("n_ok", F.lit(0)).cast("long").alias("n_ok"),
                    F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected")))


# ------------------------------------------------------------------ language
def _profile(spark, sf_dir, params: LangParams | None = None):
    docs = fx.table(spark, sf_dir, "documents")
    return language.train(docs.select("text", "lang"), params=params)


def _lang_sql_parts(target: str, id_expr: str, text_expr: str, where: str = "TRUE") -> str:
    # Characters of the padded letter string, then overlapping 3-grams by index.
    chars = "string_split(' ' || trim(regexp_replace(lower(coalesce({t}, '')), '[^\\pL]+', ' ', 'g')) || ' ', '')"
    grams = ("list_transform(range(1, greatest(len(ch) - 2, 1) + 1), "
             "lambda i: ch[i] || coalesce(ch[i + 1], '') || coalesce(ch[i + 2], ''))")
    return f"""
prof_counts AS (
  SELECT lang, g AS gram, count(*) AS c
  FROM (SELECT lang, unnest({grams}) AS g
        FROM (SELECT lang, {chars.format(t='text')} AS ch FROM documents WHERE lang IS NOT NULL))
  WHERE g <> '   ' GROUP BY lang, g
),
tot AS (SELECT lang, sum(c) + count(*) + 1 AS d FROM prof_counts GROUP BY lang),
lp AS (SELECT p.gram, p.lang, ln((p.c + 1) / t.d) - ln(1.0 / t.d) AS delta
       FROM prof_counts p JOIN tot t USING (lang)),
un AS (SELECT lang, ln(1.0 / d) AS unseen FROM tot),
tgt AS (SELECT {id_expr} AS id, {text_expr} AS text FROM {target} WHERE {where}),
tg AS (SELECT id, greatest(len(ch) - 2, 0) AS n, short, {grams} AS grams
       FROM (SELECT id, {chars.format(t='text')} AS ch,
                    length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 10 AS short FROM tgt)),
gain AS (SELECT x.id, lp.lang, sum(lp.delta) AS d
         FROM (SELECT id, unnest(grams) AS gram FROM tg) x JOIN lp USING (gram) GROUP BY x.id, lp.lang),
sc AS (SELECT tg.id, un.lang, tg.n * un.unseen + coalesce(gain.d, 0.0) AS score, tg.short
       FROM tg CROSS JOIN un LEFT JOIN gain ON gain.id = tg.id AND gain.lang = un.lang),
best AS (SELECT id, lang AS raw_language, short FROM sc
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang ASC) = 1),
det AS (SELECT id, CASE WHEN short THEN 'en' WHEN raw_language IN ('en', 'es', 'fr') THEN raw_language ELSE 'en' END AS language,
               raw_language, raw_language IN ('en', 'es', 'fr') AS supported FROM best)
"""


@register("l1_language_documents", sql="WITH " + _lang_sql_parts("documents", "doc_id", "text") + """
SELECT id AS doc_id, language, raw_language, supported FROM det
""")
def l1_language_documents(spark, sf_dir):
    """Language of every document (3-gram profiles trained on the labelled
    documents), with the short-text and unsupported-language fallbacks."""
    docs = fx.table(spark, sf_dir, "documents")
    prof = _profile(spark, sf_dir)
    return language.detect(docs, prof, "doc_id", "text")


@register("l1_language_accuracy", sql="WITH " + _lang_sql_parts("documents", "doc_id", "text") + """
SELECT CASE WHEN d.lang IN ('en', 'es', 'fr') THEN d.lang ELSE 'en' END AS expected, count(*) AS n,
       sum(CASE WHEN det.language = (CASE WHEN d.lang IN ('en', 'es', 'fr') THEN d.lang ELSE 'en' END) THEN 1 ELSE 0 END)::BIGINT AS n_correct
FROM det JOIN documents d ON d.doc_id = det.id GROUP BY 1
""")
def l1_language_accuracy(spark, sf_dir):
    """Detection accuracy against the document labels (unsupported labels expect 'en')."""
    docs = fx.table(spark, sf_dir, "documents")
    prof = _profile(spark, sf_dir)
    det = language.detect(docs, prof, "doc_id", "text")
    exp = F.when(F.col("lang").isin("en", "es", "fr"), F.col("lang")).otherwise(F.lit("en"))
    j = det.join(docs.select("doc_id", "lang"), "doc_id")
    return j.groupBy(exp.alias("expected")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("language") == exp, 1).otherwise(0)).cast("long").alias("n_correct"))


@register("l1_language_questions", sql="WITH " + _lang_sql_parts(
    "conversations", "conv_id * 2147483648 + turn", "text", "role = 'user'") + """
SELECT id AS query_id, language, raw_language, supported FROM det
""")
def l1_language_questions(spark, sf_dir):
    """Language of every user question."""
    qs = fx.user_questions(spark, sf_dir)
    prof = _profile(spark, sf_dir)
    return language.detect(qs, prof, "query_id", "text")


@register("l2_language_probs", sql="WITH " + _lang_sql_parts(
    "conversations", "conv_id * 2147483648 + turn", "text", "role = 'user'") + """
, mx AS (SELECT id, max(score) AS m FROM sc GROUP BY id),
z AS (SELECT sc.id, sum(exp(sc.score - mx.m)) AS z FROM sc JOIN mx USING (id) GROUP BY sc.id)
SELECT sc.id AS query_id, sc.lang, round(exp(sc.score - mx.m) / z.z, 6) AS prob
FROM sc JOIN mx USING (id) JOIN z USING (id) WHERE NOT sc.short
UNION ALL
SELECT id AS query_id, 'en' AS lang, 1.0 AS prob FROM tg WHERE short
""")
def l2_language_probs(spark, sf_dir):
    """Probability of every profiled language for every user question."""
    qs = fx.user_questions(spark, sf_dir)
    prof = _profile(spark, sf_dir)
    return language.probabilities(qs, prof, "query_id", "text")


_CLEANED = Q.clean("text")


@register("p15_prepare_questions", sql="WITH " + _lang_sql_parts(
    "conversations", "conv_id * 2147483648 + turn", Q.clean("text"), "role = 'user'") + f"""
, pr AS (
  SELECT conv_id * 2147483648 + turn AS query_id, length(text)::BIGINT AS text_length,
         length({_CLEANED})::BIGINT AS cleaned_length,
         length({Q.redact(_CLEANED)})::BIGINT AS anonymized_length,
         (len({Q.matches(_CLEANED, 'EMAIL_ADDRESS')}) + len({Q.matches(_CLEANED, 'CREDIT_CARD')})
          + len({Q.matches(_CLEANED, 'SSN')}) + len({Q.matches(_CLEANED, 'PHONE_NUMBER')})
          + len({Q.matches(_CLEANED, 'PERSON')}))::BIGINT AS pii_count
  FROM conversations WHERE role = 'user'
)
SELECT pr.query_id, det.language, pr.text_length, pr.cleaned_length, pr.anonymized_length, pr.pii_count
FROM pr JOIN det ON det.id = pr.query_id
""")
def p15_prepare_questions(spark, sf_dir):
    """Preparation record of every user question: clean -> language (on the
    cleaned text) -> PII redaction, with lengths and the entity count."""
    from .prep import prepare

    prof = _profile(spark, sf_dir)
    rec = prepare(fx.user_questions(spark, sf_dir), prof, "query_id", "text")
    return rec.select("query_id", "language", "text_length", "cleaned_length", "anonymized_length", "pii_count")
