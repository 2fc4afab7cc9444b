"""Bulk article source, snapshots, and the small predicates of routing and caching."""

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helmsman.functions import text as T
from helmsman.operators import context, decision
from helmsman.sources import kb as KB


def test_articles_are_read_by_schema_and_ingested(spark, scratch):
    """Missing fields are null, unknown ones are left out, articles without
    content are rejected and ids go on from the largest."""
    rows = [{"title": "b", "content": "second", "metadata": {"lang": "en"}, "other": 1}, {"title": "a", "content": "first"}, {"title": "c", "content": ""}, {"title": "d"}]
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(f"{scratch}/articles")
    articles = KB.read_articles(spark, f"{scratch}/articles")
    assert articles.columns == ["title", "content", "metadata"] and articles.count() == 4
    empty = spark.createDataFrame([], KB.KB_SCHEMA)
    once = KB.ingest(empty, articles, datetime(2024, 1, 1))
    assert [(r["id"], r["title"], r["metadata"]) for r in once.orderBy("id").collect()] == [(1, "a", {}), (2, "b", {"lang": "en"})]


def test_snapshots_are_never_overwritten(spark, scratch):
    kb = spark.createDataFrame([], KB.KB_SCHEMA)
    path = KB.write_snapshot(kb, scratch, 1)
    assert KB.read_snapshot(spark, path).schema.names == KB.KB_SCHEMA.names
    with pytest.raises(AnalysisException):
        KB.write_snapshot(kb, scratch, 1)


def test_auto_response_predicate(spark):
    """True for the automatic route alone; no route gives null."""
    df = spark.createDataFrame([("auto_response",), ("human_handoff",), (None,)], "route string")
    assert [r[0] for r in df.select(decision.should_auto_respond("route")).collect()] == [True, False, None]


def test_token_truncation(spark):
    df = spark.createDataFrame([(list("abcd"),), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(T.truncate_tokens("t", 3)).collect()] == [["a", "b", "c"], [], None]


def test_cached_answers_expire(spark):
    """An answer as old as the time to live is still valid, an older one is not."""
    log = spark.createDataFrame([(1, "2024-01-01 11:00:00"), (2, "2024-01-01 10:59:59"), (3, None)], "query_id long, at string")
    log = log.select("query_id", F.col("at").cast("timestamp").alias("created_at"))
    assert [r["query_id"] for r in context.cached_still_valid(log, datetime(2024, 1, 1, 12), 3600).collect()] == [1]
