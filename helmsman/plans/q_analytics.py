"""Registered analytics queries (A1-A26) over the logs derived from ``events``
(and retrieval results for the evaluation jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIDENCE_BUCKETS, DURATION_BUCKETS, STAGE_BUCKETS
from ..functions.numeric import r6
from ..operators import analytics as A
from ..operators import decision
from ..sources import fixtures as fx
from . import sql_decision as SD
from .registry import register

LOG_SQL = """
log AS (
  SELECT event_id AS query_id, ts AS created_at, user_id, event_type, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'human_handoff' ELSE 'auto_response' END AS routing_decision,
         value / 500.0 AS confidence_score,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, props
  FROM events
),
ref AS (SELECT max(ts) AS t FROM events)
"""


def _log(spark, sf_dir):
    return fx.request_log(spark, sf_dir)


def _hist_sql(value: str, bounds, where: str = "TRUE", groups: str = "") -> str:
    gsel = f"{groups}, " if groups else ""
    gby = f"GROUP BY {groups}" if groups else ""
    parts = [f"SELECT {gsel}'{float(b)}' AS le, sum(CASE WHEN {value} <= {float(b)} THEN 1 ELSE 0 END)::BIGINT AS count "
             f"FROM log WHERE {where} {gby}" for b in bounds]
    parts.append(f"SELECT {gsel}'+Inf' AS le, count(*)::BIGINT AS count FROM log WHERE {where} {gby}")
    return " UNION ALL ".join(parts)


@register("a1_kpi_24h", sql=f"""
WITH {LOG_SQL},
w AS (SELECT * FROM log, ref WHERE created_at >= ref.t - INTERVAL 86400 SECOND AND created_at <= ref.t)
SELECT count(*)::BIGINT AS total_queries,
       coalesce(sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END), 0)::BIGINT AS auto_responses,
       coalesce(sum(CASE WHEN routing_decision = 'human_handoff' THEN 1 ELSE 0 END), 0)::BIGINT AS human_handoffs,
       round(CASE WHEN count(*) > 0 THEN coalesce(sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END), 0) / count(*) ELSE 0.0 END, 6) AS deflection_ratio,
       round(coalesce(avg(confidence_score), 0.0), 6) AS avg_confidence,
       round(coalesce(avg(latency_ms), 0.0), 6) AS avg_latency_ms
FROM w
""")
def a1_kpi_24h(spark, sf_dir):
    """KPI row over the trailing 24 hours before the latest event."""
    log = _log(spark, sf_dir)
    return A.kpi(A.trailing(log, fx.as_of(spark, sf_dir), 24))


@register("a2_deflection_daily", sql=f"""
WITH {LOG_SQL}
SELECT CAST(created_at AS DATE) AS day, count(*)::BIGINT AS total_queries,
       round(sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END) / count(*), 6) AS deflection_ratio,
       CASE WHEN sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END) / count(*) < 0.5 THEN 'red'
            WHEN sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END) / count(*) < 0.7 THEN 'yellow'
            ELSE 'green' END AS band
FROM log GROUP BY 1
""")
def a2_deflection_daily(spark, sf_dir):
    """Deflection ratio per day and its panel band."""
    log = _log(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    g = log.groupBy("day").agg(F.count(F.lit(1)).alias("total_queries"),
                               F.sum(F.when(F.col("routing_decision") == "auto_response", 1).otherwise(0)).alias("auto"))
    ratio = F.col("auto") / F.col("total_queries")
    return g.select("day", "total_queries", r6(ratio).alias("deflection_ratio"), A.deflection_band(ratio).alias("band"))


@register("a4_queries_by_status", sql=f"""
WITH {LOG_SQL} SELECT status, count(*)::BIGINT AS n FROM log GROUP BY status
""")
def a4_queries_by_status(spark, sf_dir):
    """Query counter by status."""
    return _log(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("a5_duration_histogram", sql=f"""
WITH {LOG_SQL} {_hist_sql('latency_ms / 1000.0', DURATION_BUCKETS, "status = 'success'")}
""")
def a5_duration_histogram(spark, sf_dir):
    """Cumulative duration buckets (seconds) of successful queries."""
    log = _log(spark, sf_dir).filter(F.col("status") == "success")
    return A.cumulative_histogram(log, F.col("latency_ms") / 1000.0, DURATION_BUCKETS)


@register("a6_confidence_histogram", sql=f"""
WITH {LOG_SQL} {_hist_sql('confidence_score', CONFIDENCE_BUCKETS, 'TRUE', 'routing_decision')}
""")
def a6_confidence_histogram(spark, sf_dir):
    """Routing counter with the cumulative confidence histogram per decision."""
    log = _log(spark, sf_dir)
    return A.cumulative_histogram(log, F.col("confidence_score"), CONFIDENCE_BUCKETS, ["routing_decision"])


@register("a7_sentiment_counter", sql=f"""
SELECT {SD.SENTIMENT_LABEL} AS label, count(*)::BIGINT AS n
FROM (SELECT {SD.polar_counts('text')} FROM conversations WHERE role = 'user') GROUP BY 1
""")
def a7_sentiment_counter(spark, sf_dir):
    """Sentiment label counter over every user question."""
    qs = fx.user_questions(spark, sf_dir)
    return qs.groupBy(decision.sentiment("text")["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("a8_stage_histogram", sql=f"""
WITH {LOG_SQL} {_hist_sql('latency_ms / 1000.0', STAGE_BUCKETS, 'TRUE', 'event_type')}
""")
def a8_stage_histogram(spark, sf_dir):
    """Stage-duration histogram (the event type is the stage label)."""
    log = _log(spark, sf_dir)
    return A.cumulative_histogram(log, F.col("latency_ms") / 1000.0, STAGE_BUCKETS, ["event_type"])


@register("a9_kb_counters", sql="""
SELECT d.source, count(*)::BIGINT AS ingested, count(e.vec_id)::BIGINT AS with_vector,
       count(*)::BIGINT AS active_documents
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source
""")
def a9_kb_counters(spark, sf_dir):
    """KB counters per source: ingested, with a vector, active (gauge)."""
    kb = fx.knowledge_base(spark, sf_dir)
    return kb.groupBy(F.col("metadata")["source"].alias("source")).agg(
        F.count(F.lit(1)).alias("ingested"), F.count("embedding").alias("with_vector"),
        F.sum(F.when(F.col("is_active"), 1).otherwise(0)).cast("long").alias("active_documents"))


_HTTP = """CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END"""


@register("a10_http_requests", sql=f"""
WITH {LOG_SQL}
SELECT {_HTTP} AS method, '/' || event_type AS endpoint, CASE WHEN status = 'error' THEN 500 ELSE 200 END AS http_status,
       count(*)::BIGINT AS n, round(avg(latency_ms / 1000.0), 6) AS avg_seconds
FROM log GROUP BY 1, 2, 3
""")
def a10_http_requests(spark, sf_dir):
    """HTTP request counter and mean latency by method, endpoint and status."""
    log = _log(spark, sf_dir)
    method = F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST")
    status = F.when(F.col("status") == "error", 500).otherwise(200)
    return log.groupBy(method.alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
                       status.alias("http_status")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("latency_ms") / 1000.0)).alias("avg_seconds"))


@register("a11_generation_tokens", sql="""
SELECT CASE WHEN role = 'assistant' THEN 'completion' ELSE 'prompt' END AS token_kind, count(*)::BIGINT AS requests,
       sum(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')))::BIGINT AS tokens
FROM conversations GROUP BY 1
""")
def a11_generation_tokens(spark, sf_dir):
    """Generation counters: requests and prompt/completion tokens (whitespace
    tokens of conversation turns)."""
    from ..functions.text import bm25_tokens

    conv = fx.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "completion").otherwise("prompt")
    return conv.groupBy(kind.alias("token_kind")).agg(F.count(F.lit(1)).alias("requests"),
                                                      F.sum(F.size(bm25_tokens("text"))).cast("long").alias("tokens"))


@register("a12_errors_by_type", sql=f"""
WITH {LOG_SQL}
SELECT 'E' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS VARCHAR) AS error_type,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'retrieval' ELSE 'generation' END AS component,
       count(*)::BIGINT AS n
FROM log WHERE status = 'error' GROUP BY 1, 2
""")
def a12_errors_by_type(spark, sf_dir):
    """Errors by type x component (type and component from the event's JSON props)."""
    log = _log(spark, sf_dir).filter(F.col("status") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    return log.groupBy(F.concat(F.lit("E"), F.floor(k / 10).cast("string")).alias("error_type"),
                       F.when(k < 50, "retrieval").otherwise("generation").alias("component")).agg(
        F.count(F.lit(1)).alias("n"))


@register("a13_rates_5m", sql=f"""
WITH {LOG_SQL},
x AS (SELECT time_bucket(INTERVAL 1 minute, created_at) - i * INTERVAL 1 minute AS window_start, routing_decision
      FROM log, (SELECT unnest(range(5)) AS i))
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, routing_decision, count(*)::BIGINT AS n,
       round(count(*) / 300.0, 6) AS rate
FROM x GROUP BY window_start, routing_decision
""")
def a13_rates_5m(spark, sf_dir):
    """Per-second rate of routing decisions over 5-minute windows sliding by 1 minute."""
    return A.rates(_log(spark, sf_dir), "routing_decision")


@register("a14_latency_quantiles", sql=f"""
WITH {LOG_SQL}
SELECT 0.5::DOUBLE AS q, round(round(quantile_cont(latency_ms, 0.5), 9), 6) AS value FROM log
UNION ALL SELECT 0.95::DOUBLE AS q, round(round(quantile_cont(latency_ms, 0.95), 9), 6) AS value FROM log
""")
def a14_latency_quantiles(spark, sf_dir):
    """Exact p50 / p95 latency (distributed ranking, linear interpolation)."""
    return A.quantiles(_log(spark, sf_dir), "latency_ms", [0.5, 0.95])


def _bucket_quantile_sql(q: float) -> str:
    bs = [float(b) for b in DURATION_BUCKETS]
    cum = {b: f"sum(CASE WHEN latency_ms / 1000.0 <= {b} THEN 1 ELSE 0 END)" for b in bs}
    total = "count(*)"
    rank = f"({q} * {total})"
    expr = f"{bs[-1]}"
    for i in reversed(range(len(bs))):
        lower = 0.0 if i == 0 else bs[i - 1]
        prev = "0.0" if i == 0 else cum[bs[i - 1]]
        expr = (f"CASE WHEN {cum[bs[i]]} >= {rank} THEN {lower} + ({bs[i]} - {lower}) * ({rank} - {prev}) / "
                f"({cum[bs[i]]} - {prev}) ELSE {expr} END")
    return f"round(CASE WHEN {total} > 0 THEN {expr} END, 6)"


@register("a14b_bucket_quantiles", sql=f"""
WITH {LOG_SQL}
SELECT 0.5::DOUBLE AS q, {_bucket_quantile_sql(0.5)} AS value FROM log WHERE status = 'success'
UNION ALL SELECT 0.95::DOUBLE AS q, {_bucket_quantile_sql(0.95)} AS value FROM log WHERE status = 'success'
""")
def a14b_bucket_quantiles(spark, sf_dir):
    """p50 / p95 of duration estimated from the cumulative buckets."""
    log = _log(spark, sf_dir).filter(F.col("status") == "success")
    hist = A.cumulative_histogram(log, F.col("latency_ms") / 1000.0, DURATION_BUCKETS)
    outs = [A.bucket_quantile(hist, q, DURATION_BUCKETS).select(F.lit(q).alias("q"), "value") for q in (0.5, 0.95)]
    return outs[0].unionByName(outs[1])


@register("a15_stage_p95", sql=f"""
WITH {LOG_SQL}
SELECT event_type, 0.95::DOUBLE AS q, round(round(quantile_cont(latency_ms / 1000.0, 0.95), 9), 6) AS value FROM log GROUP BY event_type
""")
def a15_stage_p95(spark, sf_dir):
    """p95 duration per stage (event type)."""
    log = _log(spark, sf_dir).withColumn("seconds", F.col("latency_ms") / 1000.0)
    return A.quantiles(log, "seconds", [0.95], ["event_type"])


@register("a16_confidence_quantiles", sql=f"""
WITH {LOG_SQL}
SELECT 0.25::DOUBLE AS q, round(round(quantile_cont(confidence_score, 0.25), 9), 6) AS value FROM log
UNION ALL SELECT 0.5::DOUBLE AS q, round(round(quantile_cont(confidence_score, 0.5), 9), 6) AS value FROM log
UNION ALL SELECT 0.75::DOUBLE AS q, round(round(quantile_cont(confidence_score, 0.75), 9), 6) AS value FROM log
UNION ALL SELECT 0.95::DOUBLE AS q, round(round(quantile_cont(confidence_score, 0.95), 9), 6) AS value FROM log
""")
def a16_confidence_quantiles(spark, sf_dir):
    """Confidence p25 / p50 / p75 / p95."""
    return A.quantiles(_log(spark, sf_dir), "confidence_score", [0.25, 0.5, 0.75, 0.95])


@register("a17_trailing_shares", sql=f"""
WITH {LOG_SQL},
w24 AS (SELECT routing_decision, count(*) AS n FROM log, ref
        WHERE created_at >= ref.t - INTERVAL 86400 SECOND AND created_at <= ref.t GROUP BY 1),
w1 AS (SELECT routing_decision, count(*) AS n FROM log, ref
       WHERE created_at >= ref.t - INTERVAL 3600 SECOND AND created_at <= ref.t GROUP BY 1)
SELECT '24h' AS span, routing_decision, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share FROM w24
UNION ALL
SELECT '1h' AS span, routing_decision, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share FROM w1
""")
def a17_trailing_shares(spark, sf_dir):
    """Decision totals and shares over the trailing 24 hours and 1 hour."""
    from pyspark.sql import Window

    log = _log(spark, sf_dir)
    t = fx.as_of(spark, sf_dir)
    out = None
    for span, hours in (("24h", 24), ("1h", 1)):
        g = A.trailing(log, t, hours).groupBy("routing_decision").agg(F.count(F.lit(1)).alias("n"))
        # The grouped result has one row per decision label: a tiny window.
        g = g.select(F.lit(span).alias("span"), "routing_decision", "n",
                     r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
        out = g if out is None else out.unionByName(g)
    return out


@register("a19_alerts_daily", sql=f"""
WITH {LOG_SQL}
SELECT CAST(created_at AS DATE) AS day,
       round(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate,
       round(sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END) / count(*), 6) AS deflection,
       round(round(quantile_cont(latency_ms / 1000.0, 0.95), 9), 6) AS p95_latency_s,
       sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / count(*) > 0.1 AS alert_error_rate,
       sum(CASE WHEN routing_decision = 'auto_response' THEN 1 ELSE 0 END) / count(*) < 0.5 AS alert_deflection,
       round(round(quantile_cont(latency_ms / 1000.0, 0.95), 9), 6) > 5.0 AS alert_p95_latency
FROM log GROUP BY 1
""")
def a19_alerts_daily(spark, sf_dir):
    """Daily alert rows: error rate > 0.1, deflection < 0.5, p95 latency > 5 s."""
    return A.alerts(_log(spark, sf_dir))


@register("a21_sentiment_accuracy", sql=f"""
SELECT CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'positive' END AS truth, p.label AS predicted, count(*)::BIGINT AS n
FROM labels l JOIN (SELECT doc_id, {SD.SENTIMENT_LABEL} AS label FROM (SELECT doc_id, {SD.polar_counts('text')} FROM documents)) p
  USING (doc_id)
GROUP BY 1, 2
""")
def a21_sentiment_accuracy(spark, sf_dir):
    """Confusion counts of lexicon sentiment against the toxic label (toxic -> negative)."""
    docs = fx.table(spark, sf_dir, "documents")
    labels = fx.table(spark, sf_dir, "labels")
    pred = docs.select("doc_id", decision.sentiment("text")["label"].alias("predicted"))
    j = labels.join(pred, "doc_id")
    truth = F.when(F.col("toxic") == 1, "negative").otherwise("positive")
    return j.groupBy(truth.alias("truth"), "predicted").agg(F.count(F.lit(1)).alias("n"))


_ACTION = ("CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_type = 'error' THEN 'rejected' "
           "WHEN event_type = 'click' THEN 'responded' ELSE 'assigned' END")


@register("a22_agent_acceptance", sql=f"""
SELECT user_id AS agent_id,
       sum(CASE WHEN {_ACTION} = 'approved' THEN 1 ELSE 0 END)::BIGINT AS approved,
       sum(CASE WHEN {_ACTION} IN ('approved', 'rejected') THEN 1 ELSE 0 END)::BIGINT AS decided,
       round(CASE WHEN sum(CASE WHEN {_ACTION} IN ('approved', 'rejected') THEN 1 ELSE 0 END) > 0
                  THEN sum(CASE WHEN {_ACTION} = 'approved' THEN 1 ELSE 0 END)
                       / sum(CASE WHEN {_ACTION} IN ('approved', 'rejected') THEN 1 ELSE 0 END) END, 6) AS acceptance
FROM events GROUP BY user_id
""")
def a22_agent_acceptance(spark, sf_dir):
    """Agent acceptance ratio approved / (approved + rejected) per agent."""
    from ..sources import sinks

    acts = sinks.agent_interactions(spark, sf_dir)
    g = acts.groupBy("agent_id").agg(
        F.sum(F.when(F.col("action") == "approved", 1).otherwise(0)).cast("long").alias("approved"),
        F.sum(F.when(F.col("action").isin("approved", "rejected"), 1).otherwise(0)).cast("long").alias("decided"))
    return g.select(F.col("agent_id").cast("long").alias("agent_id"), "approved", "decided",
                    r6(F.when(F.col("decided") > 0, F.col("approved") / F.col("decided"))).alias("acceptance"))


@register("a24_ab_arms", sql=f"""
WITH {LOG_SQL}
SELECT user_id % 2 AS arm, count(*)::BIGINT AS n,
       round(avg(CASE WHEN confidence_score >= (CASE WHEN user_id % 2 = 0 THEN 0.8 ELSE 0.6 END) THEN 1.0 ELSE 0.0 END), 6) AS deflection,
       round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN -1.0 END), 6) AS satisfaction,
       round(avg(latency_ms), 6) AS resolution_ms,
       sum(CASE WHEN confidence_score < (CASE WHEN user_id % 2 = 0 THEN 0.8 ELSE 0.6 END) THEN 1 ELSE 0 END)::BIGINT AS human_workload
FROM log GROUP BY 1
""")
def a24_ab_arms(spark, sf_dir):
    """A/B arms by user (threshold 0.8 vs 0.6): deflection, satisfaction,
    resolution time and human workload."""
    log = _log(spark, sf_dir)
    arm = F.col("user_id") % 2
    thr = F.when(arm == 0, 0.8).otherwise(0.6)
    fb = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0)
    return log.groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(F.when(F.col("confidence_score") >= thr, 1.0).otherwise(0.0))).alias("deflection"),
        r6(F.avg(fb)).alias("satisfaction"),
        r6(F.avg("latency_ms")).alias("resolution_ms"),
        F.sum(F.when(F.col("confidence_score") < thr, 1).otherwise(0)).cast("long").alias("human_workload"))


@register("a25_feedback_summary", sql="""
SELECT CASE WHEN event_type = 'purchase' THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback_type, count(*)::BIGINT AS n,
       round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END), 6) AS satisfaction,
       count(*) >= 100 AS retrain
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1
""")
def a25_feedback_summary(spark, sf_dir):
    """Feedback count and satisfaction per type, with the retrain flag (>= 100)."""
    return A.feedback_summary(fx.feedback_log(spark, sf_dir))


def _endpoint_log(spark, sf_dir):
    log = _log(spark, sf_dir)
    method = F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST")
    return log.withColumns({"method": method, "endpoint": F.concat(F.lit("/"), F.col("event_type"))})


@register("a10_http_latency_histogram", sql=f"""
WITH {LOG_SQL.replace('log AS (', 'log0 AS (', 1)},
log AS (SELECT *, {_HTTP} AS method, '/' || event_type AS endpoint FROM log0)
{_hist_sql('latency_ms / 1000.0', DURATION_BUCKETS, 'TRUE', 'method, endpoint')}
""")
def a10_http_latency_histogram(spark, sf_dir):
    """Cumulative HTTP latency buckets by method and endpoint."""
    return A.cumulative_histogram(_endpoint_log(spark, sf_dir), F.col("latency_ms") / 1000.0, DURATION_BUCKETS, ["method", "endpoint"])


@register("a13_http_rates_5m", sql=f"""
WITH {LOG_SQL},
x AS (SELECT time_bucket(INTERVAL 1 minute, created_at) - i * INTERVAL 1 minute AS window_start, '/' || event_type AS endpoint
      FROM log, (SELECT unnest(range(5)) AS i))
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, endpoint, count(*)::BIGINT AS n,
       round(count(*) / 300.0, 6) AS rate
FROM x GROUP BY window_start, endpoint
""")
def a13_http_rates_5m(spark, sf_dir):
    """Per-second request rate of every endpoint over 5-minute windows sliding by 1 minute."""
    return A.rates(_endpoint_log(spark, sf_dir), "endpoint")


@register("a19_error_rate_5m", sql=f"""
WITH {LOG_SQL}
SELECT time_bucket(INTERVAL 5 minute, created_at) AS window_start, count(*)::BIGINT AS n,
       round(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate,
       sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / count(*) > 0.1 AS alert_error_rate
FROM log GROUP BY 1
""")
def a19_error_rate_5m(spark, sf_dir):
    """Error rate and its alert (> 0.1) in every 5-minute window."""
    share = F.avg(F.when(F.col("status") == "error", 1.0).otherwise(0.0))
    g = _log(spark, sf_dir).groupBy(F.window("created_at", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), share.alias("share"))
    return g.select(F.col("w.start").alias("window_start"), "n", r6("share").alias("error_rate"), (F.col("share") > 0.1).alias("alert_error_rate"))


@register("a21_sentiment_scores", sql=f"""
WITH p AS (SELECT l.toxic = 1 AS truth, p.label = 'negative' AS said
           FROM labels l JOIN (SELECT doc_id, {SD.SENTIMENT_LABEL} AS label FROM (SELECT doc_id, {SD.polar_counts('text')} FROM documents)) p USING (doc_id))
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN truth = said THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(sum(CASE WHEN truth AND said THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN said THEN 1 ELSE 0 END), 0), 6) AS negative_precision,
       round(sum(CASE WHEN truth AND said THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN truth THEN 1 ELSE 0 END), 0), 6) AS negative_recall
FROM p
""")
def a21_sentiment_scores(spark, sf_dir):
    """Accuracy of lexicon sentiment against the toxic label, and precision and
    recall of its negative label (null where nothing is negative)."""
    pred = fx.table(spark, sf_dir, "documents").select("doc_id", (decision.sentiment("text")["label"] == "negative").alias("said"))
    j = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")).join(pred, "doc_id")

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    both = n(F.col("truth") & F.col("said"))
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("truth") == F.col("said"), 1.0).otherwise(0.0))).alias("accuracy"),
                 r6(both / F.nullif(n(F.col("said")), F.lit(0))).alias("negative_precision"),
                 r6(both / F.nullif(n(F.col("truth")), F.lit(0))).alias("negative_recall"))


@register("a25_feedback_by_value", sql="""
SELECT CASE WHEN event_type = 'purchase' THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback_type,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS feedback_value, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2, 3
""")
def a25_feedback_by_value(spark, sf_dir):
    """Feedback counts by type, value and day."""
    fb = fx.feedback_log(spark, sf_dir)
    return fb.groupBy("feedback_type", "feedback_value", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
