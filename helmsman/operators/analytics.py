"""Operating figures over the logged tables (KPIs, histograms, rates,
quantiles, alerts, evaluation).  Every job is a filter + aggregate; bucket
bounds and thresholds are bounded parameter lists evaluated as conditional
aggregates (no join against a bounds table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (ALERT_ERROR_RATE, ALERT_MIN_DEFLECTION, ALERT_P95_LATENCY_S, CONFIDENCE_BUCKETS,
                      DURATION_BUCKETS, RETRAIN_THRESHOLD)
from ..functions.numeric import r6, r6_stable
from .numbering import exact_quantiles


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trailing(df: DataFrame, as_of, hours: float, ts: str = "created_at") -> DataFrame:
    """Rows with ``as_of - hours <= ts <= as_of`` (``as_of`` is a parameter, never now())."""
    lo = F.lit(as_of) - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= F.lit(as_of)))


def kpi(log: DataFrame) -> DataFrame:
    """Total, auto, human, deflection, avg confidence, avg latency (nulls -> 0)."""
    total = F.count(F.lit(1))
    auto = F.sum(F.when(F.col("routing_decision") == "auto_response", 1).otherwise(0))
    human = F.sum(F.when(F.col("routing_decision") == "human_handoff", 1).otherwise(0))
    g = log.agg(total.alias("total"), auto.alias("auto"), human.alias("human"),
                F.avg("confidence_score").alias("avg_confidence"), F.avg("latency_ms").alias("avg_latency_ms"))
    return g.select(
        F.col("total").cast("long").alias("total_queries"),
        F.coalesce("auto", F.lit(0)).cast("long").alias("auto_responses"),
        F.coalesce("human", F.lit(0)).cast("long").alias("human_handoffs"),
        r6(F.when(F.col("total") > 0, F.coalesce("auto", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))).alias("deflection_ratio"),
        r6(F.coalesce("avg_confidence", F.lit(0.0))).alias("avg_confidence"),
        r6(F.coalesce("avg_latency_ms", F.lit(0.0))).alias("avg_latency_ms"),
    )


def deflection_band(ratio) -> Column:
    """A2 panel colours: below 0.5 red, below 0.7 yellow, else green."""
    r = _col(ratio)
    return F.when(r < 0.5, "red").when(r < 0.7, "yellow").otherwise("green")


def cumulative_histogram(df: DataFrame, value: Column, bounds, group_cols: list[str] | None = None) -> DataFrame:
    """Prometheus-style cumulative buckets (le, count) incl. +Inf."""
    groups = list(group_cols or [])
    aggs = [F.sum(F.when(value <= F.lit(float(b)), 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias("binf"))
    g = df.groupBy(*groups).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").cast("long").alias("count"))
                      for i, b in enumerate(bounds)],
                    F.struct(F.lit("+Inf").alias("le"), F.col("binf").cast("long").alias("count")))
    return g.select(*groups, F.explode(pairs).alias("e")).select(*groups, "e.le", "e.count")


def bucket_quantile(hist: DataFrame, q: float, bounds, group_cols: list[str] | None = None) -> DataFrame:
    """A14(b): quantile estimated from cumulative buckets with linear
    interpolation inside the bucket (lower bound 0 for the first bucket; the
    +Inf bucket returns the highest finite bound)."""
    groups = list(group_cols or [])
    les = [float(b) for b in bounds]
    w = hist.groupBy(*groups).pivot("le", [str(b) for b in les] + ["+Inf"]).agg(F.first("count"))
    cums = [F.col(f"`{str(b)}`") for b in les]
    total = F.col("`+Inf`")
    rank = F.lit(q) * total
    expr = F.lit(les[-1])
    for i in reversed(range(len(les))):
        lower = F.lit(0.0) if i == 0 else F.lit(les[i - 1])
        prev = F.lit(0.0) if i == 0 else cums[i - 1]
        val = lower + (F.lit(les[i]) - lower) * (rank - prev) / (cums[i] - prev)
        expr = F.when(cums[i] >= rank, val).otherwise(expr)
    return w.select(*groups, r6(F.when(total > 0, expr)).alias("value"))


def rates(df: DataFrame, label: str, window: str = "5 minutes", slide: str = "1 minute", ts: str = "created_at",
          seconds: int = 300) -> DataFrame:
    """Per-second rate per label over sliding windows.  Rows are counted into
    panes of one slide; only panes are copied into the windows they lie in."""
    panes = df.groupBy(F.window(ts, slide).alias("p"), F.col(label)).agg(F.count(F.lit(1)).alias("n"))
    panes = panes.select(F.col("p.start").alias("_at"), F.col(label), "n")
    g = panes.groupBy(F.window("_at", window, slide).alias("w"), F.col(label)).agg(F.sum("n").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col(label),
                    F.col("n").cast("long").alias("n"), r6(F.col("n") / F.lit(float(seconds))).alias("rate"))


def quantiles(df: DataFrame, value: str, qs, group_cols: list[str] | None = None) -> DataFrame:
    """Exact quantiles (distributed ranking)."""
    out = exact_quantiles(df, value, list(qs), group_cols)
    return out.select(*(group_cols or []), "q", r6_stable("value").alias("value"))


def alerts(log: DataFrame, key: str = "day") -> DataFrame:
    """Per day error rate, deflection, p95 latency and the firing flags."""
    d = log.withColumn(key, F.to_date("created_at"))
    g = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("routing_decision") == "auto_response", 1).otherwise(0)).alias("auto"),
    )
    p95 = quantiles(d.withColumn("latency_s", F.col("latency_ms") / 1000.0), "latency_s", [0.95], [key])
    j = g.join(p95.select(key, F.col("value").alias("p95_latency_s")), key, "left")
    er = F.col("errors") / F.col("n")
    de = F.col("auto") / F.col("n")
    return j.select(
        key, r6(er).alias("error_rate"), r6(de).alias("deflection"), F.col("p95_latency_s"),
        (er > ALERT_ERROR_RATE).alias("alert_error_rate"),
        (de < ALERT_MIN_DEFLECTION).alias("alert_deflection"),
        (F.col("p95_latency_s") > ALERT_P95_LATENCY_S).alias("alert_p95_latency"),
    )


def precision_at_k(hits: DataFrame, relevance: DataFrame, k: int, method_col: str | None = None) -> DataFrame:
    """Mean relevance of hits with rank <= k (relevance (query_id, doc_id, rel))."""
    j = hits.filter(F.col("rank") <= k).join(relevance, ["query_id", "doc_id"], "left")
    groups = [method_col] if method_col else []
    return j.groupBy(*groups).agg(r6(F.avg(F.coalesce("rel", F.lit(0)).cast("double"))).alias("precision"),
                                  F.count(F.lit(1)).alias("n_hits"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Count and satisfaction (mean value) per type and the retrain flag."""
    g = feedback.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"),
                                              r6(F.avg("feedback_value")).alias("satisfaction"))
    return g.withColumn("retrain", F.col("n") >= F.lit(RETRAIN_THRESHOLD))


DURATIONS = DURATION_BUCKETS
CONFIDENCES = CONFIDENCE_BUCKETS
