"""Decision jobs: confidence, sentiment, urgency, sensitive topics, routing.

Confidence is one aggregate of the (bounded, top-k) hits per query.  Every
text classifier is a column expression (keyword lists are bounded parameters
evaluated with array higher-order functions), so routing adds no shuffle
beyond the join of per-query confidence back to the questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVEL_HIGH, LEVEL_MEDIUM, DecisionParams

# Default polarity lexicon of the built-in sentiment scorer (a parameter; a
# model can be plugged in instead, see helmsman.plugins).
POSITIVE_WORDS: tuple[str, ...] = (
    "good", "great", "excellent", "thanks", "thank", "love", "happy", "helpful", "perfect", "nice",
    "awesome", "resolved", "works", "working", "pleased", "glad", "best", "fast", "easy", "amazing",
)
NEGATIVE_WORDS: tuple[str, ...] = (
    "bad", "terrible", "awful", "angry", "hate", "broken", "worst", "slow", "problem", "error",
    "fail", "failed", "useless", "refund", "wrong", "disappointed", "never", "annoyed", "poor", "issue",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


# ---------------------------------------------------------------- confidence
def confidence(hits: DataFrame, queries: DataFrame, params: DecisionParams | None = None,
               score_col: str = "combined_score", key: str = "query_id") -> DataFrame:
    """(query_id, confidence, n_hits) for every query; no hits -> 0.

    0.4*top + 0.3*consistency + 0.3*min(1, n_above/3), clamped to [0, 1];
    consistency = clamp(1 - std_pop/(mean + 1e-9)) over ranks 1..3 (1.0 with
    a single hit); n_above counts every hit with score >= min_retrieval_score."""
    p = params or DecisionParams()
    w_top, w_cons, w_thr = p.weights
    s = F.col(score_col)
    in3 = F.col("rank") <= p.consistency_window
    agg = hits.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, s)).alias("top"),
        F.stddev_pop(F.when(in3, s)).alias("sd3"),
        F.avg(F.when(in3, s)).alias("mean3"),
        F.count(F.when(in3, s)).alias("n3"),
        F.count(F.when(s >= p.min_retrieval_score, s)).alias("n_above"),
        F.count(F.lit(1)).alias("n_hits"),
    )
    cons = F.when(F.col("n3") > 1,
                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("sd3") / (F.col("mean3") + F.lit(1e-9))))
                  ).otherwise(F.lit(1.0))
    thr = F.least(F.lit(1.0), F.col("n_above") / F.lit(3.0))
    conf = F.lit(w_top) * F.col("top") + F.lit(w_cons) * cons + F.lit(w_thr) * thr
    scored = agg.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), "n_hits")
    return (queries.select(key).join(scored, key, "left")
            .select(key, F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits")))


def is_high_confidence(c, params: DecisionParams | None = None) -> Column:
    """D2."""
    p = params or DecisionParams()
    return _col(c) >= F.lit(p.threshold)


def confidence_level(c) -> Column:
    """D3."""
    c = _col(c)
    return F.when(c >= LEVEL_HIGH, "high").when(c >= LEVEL_MEDIUM, "medium").otherwise("low")


# ----------------------------------------------------------------- sentiment
def words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"(?U)\w+"), 0)


def sentiment(c, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """struct(label, score) from a polarity lexicon over the whole text.

    label by the sign of (#positive - #negative) word occurrences; score =
    0.5 + 0.5*|pos - neg|/(pos + neg); empty text or no polar word -> neutral 0.5."""
    pos_arr = F.array(*[F.lit(x) for x in positive])
    neg_arr = F.array(*[F.lit(x) for x in negative])
    empty = F.coalesce(F.length(_col(c)), F.lit(0)) == 0

    def counts(w):
        return F.struct(F.size(F.filter(w, lambda t: F.array_contains(pos_arr, t))).alias("pos"),
                        F.size(F.filter(w, lambda t: F.array_contains(neg_arr, t))).alias("neg"))

    def judged(n):
        pos, neg = n["pos"], n["neg"]
        tot = pos + neg
        label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
        score = F.when(tot > 0, F.lit(0.5) + F.lit(0.5) * F.abs(pos - neg) / tot).otherwise(F.lit(0.5))
        return F.struct(F.when(empty, "neutral").otherwise(label).alias("label"),
                        F.when(empty, 0.5).otherwise(score).alias("score"))

    return _once(_once(words(c), counts), judged)


def should_escalate(label, params: DecisionParams | None = None) -> Column:
    """D5."""
    p = params or DecisionParams()
    return _col(label).isin(list(p.escalate_on))


# ------------------------------------------------------------ keyword checks
def _low(c) -> Column:
    return F.lower(F.coalesce(_col(c), F.lit("")))


def _any_in(low, keywords) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k))


def _count_in(low, keywords) -> Column:
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k)))


def any_keyword(c, keywords) -> Column:
    """Any keyword is a substring of the lowercased text."""
    return _once(_low(c), lambda low: _any_in(low, keywords))


def count_keywords(c, keywords) -> Column:
    """Number of distinct keywords present as substrings."""
    return _once(_low(c), lambda low: _count_in(low, keywords))


def is_urgent(c, params: DecisionParams | None = None) -> Column:
    """D6."""
    p = params or DecisionParams()
    return any_keyword(c, p.urgent_keywords)


def sensitive_topics(c, params: DecisionParams | None = None) -> Column:
    """struct(has_sensitive, topics, confidence); empty text -> (false, [], 0)."""
    p = params or DecisionParams()
    n_kw = sum(len(kws) for _, kws in p.topics)
    empty = F.coalesce(F.length(_col(c)), F.lit(0)) == 0

    def found(low):
        topics = F.array_compact(F.array(*[F.when(_any_in(low, kws), F.lit(name)) for name, kws in p.topics]))
        return F.struct(topics.alias("topics"), sum((_count_in(low, kws) for _, kws in p.topics), F.lit(0)).alias("matches"))

    def judged(n):
        topics = n["topics"]
        conf = F.least(F.lit(1.0), n["matches"] / F.lit(5.0)) if n_kw > 0 else F.lit(0.0)
        return F.struct(
            F.when(empty, F.lit(False)).otherwise(F.size(topics) > 0).alias("has_sensitive"),
            F.when(empty, F.array().cast("array<string>")).otherwise(topics).alias("topics"),
            F.when(empty, F.lit(0.0)).otherwise(conf.cast("double")).alias("confidence"),
        )

    return _once(_once(_low(c), found), judged)


def requires_human(topics_struct, params: DecisionParams | None = None) -> Column:
    """Sensitive and topic confidence >= threshold."""
    p = params or DecisionParams()
    t = _col(topics_struct)
    return t["has_sensitive"] & (t["confidence"] >= F.lit(p.sensitive_threshold))


# ------------------------------------------------------------------- routing
def route_reason(conf, sentiment_label, urgent, has_sensitive, params: DecisionParams | None = None) -> Column:
    """The first matching rule wins; a rule is live only if its reason is configured."""
    p = params or DecisionParams()
    reasons = set(p.handoff_reasons)
    r = F.when(F.lit(not p.auto_enabled), F.lit("auto_response_disabled"))
    if "low_confidence" in reasons:
        r = r.when(~is_high_confidence(conf, p), F.lit("low_confidence"))
    if "negative_sentiment" in reasons:
        r = r.when(_col(sentiment_label) == "negative", F.lit("negative_sentiment"))
    if "urgent" in reasons:
        r = r.when(_col(urgent), F.lit("urgency_detected"))
    if "sensitive_topic" in reasons:
        r = r.when(_col(has_sensitive), F.lit("sensitive_topic"))
    return r.otherwise(F.lit("default_auto_response"))


def route_from_reason(reason) -> Column:
    return F.when(_col(reason) == "default_auto_response", F.lit("auto_response")).otherwise(F.lit("human_handoff"))


def should_auto_respond(route) -> Column:
    """D11."""
    return _col(route) == "auto_response"


def route(questions: DataFrame, hits: DataFrame, text_col: str = "text",
          params: DecisionParams | None = None, key: str = "query_id") -> DataFrame:
    """Routing decision for every question.  The text classifiers run where the
    question rows are (no text is shuffled); only their small results meet the
    per-query confidence."""
    p = params or DecisionParams()
    t = F.col(text_col)
    cls = questions.select(key, sentiment(t).alias("sentiment"), is_urgent(t, p).alias("is_urgent"),
                           sensitive_topics(t, p).alias("sensitive_topics"))
    conf = confidence(hits, questions.select(key), p, key=key)
    out = cls.join(conf, key, "left").select(key, "confidence", "n_hits", "sentiment", "is_urgent", "sensitive_topics")
    reason = route_reason("confidence", F.col("sentiment.label"), F.col("is_urgent"),
                          F.col("sensitive_topics.has_sensitive"), p)
    return out.withColumn("reason", reason).withColumn("route", route_from_reason("reason"))
