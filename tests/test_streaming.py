"""Streaming jobs: batch = stream, stateful counter, dedupe, sessions."""

import datetime as dt
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from helmsman.streaming import jobs
from tests.conftest import SF_SMALL


def _split_events(scratch, parts=3):
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    n = t.num_rows
    d = os.path.join(scratch, "events_in")
    os.makedirs(d)
    for i in range(parts):
        pq.write_table(t.slice(i * n // parts, (i + 1) * n // parts - i * n // parts), os.path.join(d, f"part{i}.parquet"))
    return d


def test_sessions_batch_matches_pandas_with_hot_user(spark):
    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(2000):  # one user holds most rows, with gaps of 10 and 40 minutes
        rows.append((1, base + dt.timedelta(minutes=10 * i + (30 if i % 7 == 0 else 0)), "auto_response"))
    for i in range(50):
        rows.append((2 + i % 3, base + dt.timedelta(minutes=45 * i), "human_handoff"))
    log = spark.createDataFrame(rows, "user_id long, created_at timestamp, routing_decision string")
    got = sorted((r["user_id"], r["session_start"], r["n_queries"]) for r in jobs.sessions_batch(log, 1800, 16).collect())
    pdf = pd.DataFrame(rows, columns=["u", "t", "d"]).sort_values(["u", "t"])
    pdf["new"] = (pdf.groupby("u")["t"].diff() >= pd.Timedelta(minutes=30)) | pdf.groupby("u")["t"].diff().isna()
    pdf["sid"] = pdf.groupby("u")["new"].cumsum()
    exp = sorted((int(u), g["t"].min().to_pydatetime(), len(g)) for (u, _), g in pdf.groupby(["u", "sid"]))
    assert got == exp


def test_sessions_stream_equals_batch(spark, scratch):
    d = _split_events(scratch)
    stream = jobs.as_request_log(jobs.read_stream(spark, d, jobs.EVENT_SCHEMA))
    q = (jobs.sessions_stream(stream, watermark="0 seconds").writeStream.outputMode("append")
         .format("memory").queryName("w3_sessions_test")
         .option("checkpointLocation", os.path.join(scratch, "ck3")).trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {tuple(r) for r in spark.sql("select * from w3_sessions_test").collect()}
    batch = {tuple(r) for r in jobs.sessions_batch(jobs.as_request_log(spark.read.parquet(d))).collect()}
    # the watermark only closes sessions that ended before the last event
    assert streamed and streamed <= batch


def test_retrain_counter_stateful(spark, scratch):
    d = _split_events(scratch)
    ev = jobs.read_stream(spark, d, jobs.EVENT_SCHEMA).filter(F.col("event_type").isin("purchase", "error"))
    fb = ev.select(F.when(F.col("event_type") == "purchase", "thumbs_up").otherwise("thumbs_down").alias("feedback_type"))
    q = (jobs.retrain_triggers(fb, threshold=50).writeStream.outputMode("append").format("memory")
         .queryName("w4_test").option("checkpointLocation", os.path.join(scratch, "ck4"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["feedback_type"], r["fired_at_count"]) for r in spark.sql("select * from w4_test").collect())
    static = spark.read.parquet(d).filter(F.col("event_type").isin("purchase", "error")).select(
        F.when(F.col("event_type") == "purchase", "thumbs_up").otherwise("thumbs_down").alias("feedback_type"))
    exp = sorted((r["feedback_type"], r["fired_at_count"]) for r in jobs.retrain_triggers_batch(static, 50).collect())
    assert got == exp and got


def test_repeat_suppression(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, "Reset my password", base), (2, "reset  my password", base + dt.timedelta(minutes=5)),
            (3, "Reset my password", base + dt.timedelta(minutes=20)), (4, "other", base)]
    df = spark.createDataFrame(rows, "query_id long, text string, created_at timestamp")
    kept = {r["query_id"] for r in jobs.suppress_repeats(df).collect()}
    assert 4 in kept and len(kept & {1, 3}) == 1


def test_routing_stream_equals_batch(spark, scratch):
    from helmsman.plans import end_to_end
    from helmsman.sources import fixtures as fx

    kb = fx.knowledge_base(spark, SF_SMALL)
    qs = fx.vector_questions(spark, SF_SMALL)
    qdir = os.path.join(scratch, "questions")
    qs.repartition(3).write.parquet(qdir)
    stream = spark.readStream.schema(qs.schema).option("maxFilesPerTrigger", 1).parquet(qdir)
    out = os.path.join(scratch, "w1")
    q = jobs.start_routing(stream, kb, out, os.path.join(scratch, "ck1"))
    q.awaitTermination()
    streamed = {(r["query_id"], r["route"], round(r["confidence"], 6))
                for r in spark.read.parquet(os.path.join(out, "queries", "*")).collect()}
    batch = {(r["query_id"], r["route"], round(r["confidence"], 6))
             for r in end_to_end.answer(qs, kb).queries.collect()}
    assert streamed == batch


def test_durable_answer_equals_cached(spark):
    from helmsman.plans import end_to_end
    from helmsman.sources import fixtures as fx

    kb = fx.knowledge_base(spark, SF_SMALL)
    qs = fx.vector_questions(spark, SF_SMALL)
    a = {(r["query_id"], r["route"], r["confidence"]) for r in end_to_end.answer(qs, kb).queries.collect()}
    b = {(r["query_id"], r["route"], r["confidence"])
         for r in end_to_end.answer(qs, kb, params=end_to_end.BatchParams(durable=True)).queries.collect()}
    assert a == b and a


def test_ingest_stream_appends_increments(spark, scratch):
    from pyspark.sql import functions as F

    from helmsman.sources import fixtures as fx
    from helmsman.sources import kb as KB

    kb = fx.knowledge_base(spark, SF_SMALL)
    pages = fx.table(spark, SF_SMALL, "pages").select(
        F.col("url").alias("title"), F.col("html").alias("content"),
        F.create_map(F.lit("source"), F.lit("web")).alias("metadata"))
    src = os.path.join(scratch, "articles")
    pages.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    base = os.path.join(scratch, "kb")
    q = jobs.start_ingest(stream, base, kb, dt.datetime(2024, 2, 1), os.path.join(scratch, "ck6"))
    q.awaitTermination()
    inc = KB.read_snapshot(spark, f"{base}/stream=*/epoch=*")
    ids = [r["id"] for r in inc.select("id").collect()]
    max_base = kb.agg(F.max("id")).first()[0]
    assert len(ids) == pages.count() and len(set(ids)) == len(ids) and min(ids) == max_base + 1
    assert sorted(ids) == list(range(max_base + 1, max_base + 1 + len(ids)))


def test_ingest_retry_keeps_ids_and_other_streams(spark, scratch):
    from helmsman.operators import bm25
    from helmsman.sources import fixtures as fx

    kb = fx.knowledge_base(spark, SF_SMALL)
    batch = [spark.createDataFrame([(f"t{i}", f"content {i}", {"source": "web"}) for i in r], "title string, content string, metadata map<string,string>")
             for r in (range(5), range(5, 12), range(12, 15))]
    index = bm25.build_index(kb.select(fx.F.col("id").alias("doc_id"), fx.F.col("content").alias("text")))
    state = {"index": index}

    def grow(rows, _epoch):
        state["index"] = bm25.upsert_documents(state["index"], rows.select(fx.F.col("id").alias("doc_id"), fx.F.col("content").alias("text")))

    base = os.path.join(scratch, "kb")
    write = jobs.ingest_writer(base, kb, dt.datetime(2024, 2, 1), "checkpoint-a", grow)

    def ids(path):
        return sorted(r["id"] for r in spark.read.parquet(path).select("id").collect())

    write(batch[0], 0)
    write(batch[1], 1)
    first = ids(base + "/stream=*/epoch=1")
    write(batch[1], 1)  # a retried epoch
    assert ids(base + "/stream=*/epoch=1") == first
    jobs.ingest_writer(base, kb, dt.datetime(2024, 2, 1), "checkpoint-b")(batch[2], 0)
    top = kb.agg(fx.F.max("id")).first()[0]
    assert ids(base + "/stream=*/epoch=*") == list(range(top + 1, top + 16))
    assert state["index"].n_docs == index.n_docs + 12


def test_repeats_are_dropped_by_the_gap_to_the_last_kept(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, "Hi", at(0, 59)), (2, "Hi ", at(1, 1)), (3, "Hi", at(1, 59)), (4, "Hi", at(2, 10)), (5, "other", at(1, 0)), (6, "Hi", at(0, 59)), (7, None, at(0, 1))]
    got = jobs.suppress_repeats(spark.createDataFrame(rows, "query_id long, text string, created_at timestamp")).collect()
    hi = sorted(r["created_at"] for r in got if (r["text"] or "").strip().lower() == "hi")
    assert hi == [at(0, 59), at(1, 59)] and len(got) == 4


def test_routing_finds_new_rows_and_releases_its_cache(spark, scratch):
    from helmsman.operators import bm25
    from helmsman.plans import end_to_end
    from helmsman.sources import fixtures as fx

    kb, qs = fx.knowledge_base(spark, SF_SMALL), fx.vector_questions(spark, SF_SMALL).limit(5)
    index = bm25.build_index(kb.select(fx.F.col("id").alias("doc_id"), fx.F.col("content").alias("text")))
    cache = spark._jsparkSession.sharedState().cacheManager()
    before = cache.numCachedEntries() if hasattr(cache, "numCachedEntries") else None
    res = end_to_end.answer(qs, kb, index)
    res.queries.count()
    res.release()
    assert len(res.cached) == 2 and all(not d.is_cached for d in res.cached)
    assert before is None or cache.numCachedEntries() <= before + 2
    calls = []

    def current():
        calls.append(1)
        return kb, index

    src = os.path.join(scratch, "questions")
    qs.write.parquet(src)
    stream = spark.readStream.schema(qs.schema).parquet(src)
    jobs.start_routing(stream, current, os.path.join(scratch, "out"), os.path.join(scratch, "ck")).awaitTermination()
    assert calls and spark.read.parquet(os.path.join(scratch, "out", "queries")).count() == 5
