"""Registered batch twins of the streaming jobs."""

from __future__ import annotations

from ..sources import fixtures as fx
from ..streaming import jobs
from .registry import register

_LOG = """
log AS (
  SELECT user_id, ts AS created_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS handoff FROM events
),
s AS (
  SELECT *, CASE WHEN lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) IS NULL
                   OR created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) >= INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS new_s
  FROM log
),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM s)
"""


@register("w3_sessions", sql=f"""
WITH {_LOG}
SELECT user_id, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end,
       count(*)::BIGINT AS n_queries, sum(handoff)::BIGINT AS n_handoffs
FROM g GROUP BY user_id, sid
""")
def w3_sessions(spark, sf_dir):
    """Per-user sessions with a 30-minute gap: queries and handoffs per session
    (range-partitioned sessionization; a hot user is split across tasks)."""
    return jobs.sessions_batch(fx.request_log(spark, sf_dir))


@register("w4_retrain_triggers", sql="""
SELECT feedback_type, unnest(range(100, (n // 100) * 100 + 1, 100))::BIGINT AS fired_at_count, n::BIGINT AS total
FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback_type, count(*) AS n
      FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
""")
def w4_retrain_triggers(spark, sf_dir):
    """Retrain triggers: one row per 100 feedback items of a type."""
    return jobs.retrain_triggers_batch(fx.feedback_log(spark, sf_dir))


_RATES = """
WITH x AS (SELECT time_bucket(INTERVAL 1 minute, ts) - i * INTERVAL 1 minute AS window_start, value AS latency_ms,
                  CASE WHEN event_type = 'error' THEN 'human_handoff' ELSE 'auto_response' END AS routing_decision
           FROM events, (SELECT unnest(range(5)) AS i)),
l AS (SELECT window_start, routing_decision, list_sort(list(latency_ms)) AS v, count(*) AS n FROM x GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, routing_decision, n::BIGINT AS n, n / 300.0::DOUBLE AS rate,
       v[CAST(ceil(0.5 * n) AS BIGINT)] AS p50_latency_ms, v[CAST(ceil(0.95 * n) AS BIGINT)] AS p95_latency_ms
FROM l
"""


@register("w2_live_rates", sql=_RATES)
def w2_live_rates(spark, sf_dir):
    """Windowed rates with discrete p50/p95 latency (the streaming
    transformation on the static log), exact at any size."""
    return jobs.live_rates(jobs.as_request_log(fx.table(spark, sf_dir, "events")))


@register("w2_live_counts_by_panes", sql=f"SELECT window_start, window_end, routing_decision, n, rate FROM ({_RATES})")
def w2_live_counts_by_panes(spark, sf_dir):
    """The same windows from one-minute panes (counts; the quantiles of the sketches
    are tested for their rank error)."""
    made = jobs.live_rates_by_panes(jobs.as_request_log(fx.table(spark, sf_dir, "events")))
    return made.select("window_start", "window_end", "routing_decision", "n", "rate")
