"""Structured Streaming jobs (W1-W6) and their batch twins.

Every transformation is written once as ``DataFrame -> DataFrame`` and used on
static and streaming inputs alike.  Jobs that need per-query top-k (which a
streaming DataFrame cannot express directly) run the batch plan inside
``foreachBatch``; each micro-batch writes to a directory named by its epoch
with overwrite, so a retried epoch replaces its own output (idempotent).
Checkpoints live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RETRAIN_THRESHOLD
from ..functions import text as TX
from ..operators import context
from ..session import scratch_path, sf_path

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str = "*.parquet",
                files_per_trigger: int | None = 1) -> DataFrame:
    """A file-directory stream (new parquet files become micro-batches; with None all
    files that are there are one)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A given table as a stream of one micro-batch, whether it is a file or a folder of files."""
    path = sf_path(sf_dir, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return read_stream(spark, path, schema, files_per_trigger=None)
    return read_stream(spark, event_source_dir(sf_dir), schema, f"{name}.parquet", None)


def as_request_log(events: DataFrame) -> DataFrame:
    """The request-log projection of an event stream (same mapping as batch)."""
    return events.select(
        F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"), "user_id", "event_type",
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "human_handoff").otherwise("auto_response").alias("routing_decision"),
        (F.col("value") / 500.0).alias("confidence_score"))


# ------------------------------------------------------------- W2 live rates
def live_rates(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """5-minute windows sliding by 1 minute: count, rate per second and discrete
    p50/p95 latency per decision, exact whatever a window holds (its state is its
    distinct latencies and their counts); rows later than the watermark are dropped."""
    g = (log.withWatermark("created_at", watermark)
         .groupBy(F.window("created_at", "5 minutes", "1 minute").alias("w"), "routing_decision")
         .agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(p) for p, q in (("p50", 0.5), ("p95", 0.95))]))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "routing_decision",
                    "n", (F.col("n") / 300.0).alias("rate"), F.col("p50").alias("p50_latency_ms"), F.col("p95").alias("p95_latency_ms"))


SKETCH_K = 4_096  # a window of fewer rows is exact; above, ranks are off by about 0.1 %


def live_rates_by_panes(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """W2 for busy logs: one-minute panes hold a count and a mergeable quantile sketch
    of bounded size, and a window merges its five panes, so a row is read once and
    the state of a window does not grow with its rows.  The count is exact."""
    panes = (log.withWatermark("created_at", watermark).groupBy(F.window("created_at", "1 minute").alias("pane"), "routing_decision")
             .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("latency_ms", SKETCH_K).alias("s")))
    at = F.window_time("pane") if log.isStreaming else F.col("pane.start")
    panes = panes.select(at.alias("at"), "routing_decision", "n", "s")
    g = panes.groupBy(F.window("at", "5 minutes", "1 minute").alias("w"), "routing_decision").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("s", SKETCH_K).alias("s"))
    p = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "routing_decision",
                    "n", (F.col("n") / 300.0).alias("rate"), p(0.5).alias("p50_latency_ms"), p(0.95).alias("p95_latency_ms"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run ``stream`` over what its source holds now, appending to a Parquet sink
    below the shared ``folder``, and read the sink."""
    sink = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


# --------------------------------------------------------------- W3 sessions
def sessions_stream(log: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """W3 (streaming): per-user sessions with ``session_window``."""
    g = (log.withWatermark("created_at", watermark)
         .groupBy("user_id", F.session_window("created_at", gap).alias("s"))
         .agg(F.count(F.lit(1)).alias("n_queries"),
              F.sum(F.when(F.col("routing_decision") == "human_handoff", 1).otherwise(0)).alias("n_handoffs")))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    F.col("n_queries").cast("long"), F.col("n_handoffs").cast("long"))


def sessions_batch(log: DataFrame, gap_seconds: int = 1800, partitions: int | None = None) -> DataFrame:
    """W3 (batch, skew-safe): the same sessions without gathering a user's rows
    in one task.

    Rows are range-partitioned by (user, time); each task marks session starts
    in its sorted slice (numpy); a small table of per-(partition, user) edge
    times and start counts fixes the first row of every slice and turns local
    session numbers into global ones; sessions are then a partial/final
    aggregate by (user, session)."""
    n = partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = log.select(F.col("user_id").cast("long").alias("user_id"), F.col("created_at").alias("ts"),
                      (F.col("routing_decision") == "human_handoff").cast("int").alias("handoff"))
    ts_type = base.schema["ts"].dataType.simpleString()  # keeps timestamp or timestamp_ntz
    local = (base.repartitionByRange(n, "user_id", "ts").sortWithinPartitions("user_id", "ts")
             .withColumn("_pid", F.spark_partition_id()))
    schema = f"user_id long, ts {ts_type}, handoff int, _pid int, _start int, _lsid long"

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev_u, prev_t, cur = None, None, -1  # carried across Arrow batches
        for pdf in batches:
            if len(pdf) == 0:
                continue
            u = pdf["user_id"].to_numpy()
            t = pdf["ts"].to_numpy(dtype="datetime64[us]").astype(np.int64)
            pu = np.r_[u[0] if prev_u is None else prev_u, u[:-1]]
            pt = np.r_[t[0] if prev_t is None else prev_t, t[:-1]]
            new_user = u != pu
            if prev_u is None:
                new_user[0] = True
            start = (new_user | ((t - pt) >= gap_seconds * 1_000_000)).astype(np.int64)
            if prev_u is None:
                start[0] = 1
            seg = np.cumsum(new_user)
            lsid = pd.Series(start).groupby(seg).cumsum().to_numpy() - 1
            if not new_user[0]:
                lsid[seg == seg[0]] += cur + 1
            prev_u, prev_t, cur = u[-1], t[-1], int(lsid[-1])
            yield pdf.assign(_start=start.astype(np.int32), _lsid=lsid.astype(np.int64))

    marked = local.mapInPandas(mark, schema).persist()
    edges = marked.groupBy("_pid", "user_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"),
                                                  F.sum("_start").alias("_ns"))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("_pid")
    edges = (edges.withColumn("_prev_last", F.lag("_last").over(w))
             .withColumn("_cont", (F.col("_prev_last").isNotNull() &
                                   ((F.col("_first") - F.col("_prev_last")) < F.expr(f"INTERVAL {gap_seconds} SECONDS")))
                         .cast("int"))
             # sessions before this slice = starts in earlier slices (the first
             # row of a continuing slice does not start a new session)
             .withColumn("_ns_eff", F.col("_ns") - F.col("_cont"))
             .withColumn("_off", F.sum("_ns_eff").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ns_eff"))
             .select("_pid", "user_id", "_cont", "_off"))
    j = marked.join(F.broadcast(edges) if edges.count() <= 1_000_000 else edges, ["_pid", "user_id"])
    g = (j.withColumn("_sid", F.col("_off") + F.col("_lsid") - F.col("_cont"))
         .groupBy("user_id", "_sid").agg(F.min("ts").alias("session_start"), F.max("ts").alias("_last"),
                                         F.count(F.lit(1)).alias("n_queries"), F.sum("handoff").alias("n_handoffs")))
    return g.select("user_id", "session_start",
                    (F.col("_last") + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("session_end"),
                    F.col("n_queries").cast("long"), F.col("n_handoffs").cast("long"))


# ------------------------------------------------------- W4 feedback counter
TRIGGER_SCHEMA = "feedback_type string, fired_at_count long, total long"
COUNT_STATE = "count long"


def retrain_triggers(feedback: DataFrame, threshold: int = RETRAIN_THRESHOLD) -> DataFrame:
    """W4 (streaming): one row each time a feedback type accumulates another
    ``threshold`` items (state: running count per type).  Every task counts its
    own rows first, so a hot type sends one row per task to its state."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for kind, n in batch["feedback_type"].value_counts(dropna=False).items():
                kind = None if pd.isna(kind) else kind
                total[kind] = total.get(kind, 0) + int(n)
        yield pd.DataFrame({"feedback_type": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        n = sum(int(p["n"].sum()) for p in pdfs)
        total = seen + n
        fired = list(range((seen // threshold + 1) * threshold, total + 1, threshold))
        state.update((total,))
        if fired:
            yield pd.DataFrame({"feedback_type": [key[0]] * len(fired), "fired_at_count": fired,
                                "total": [total] * len(fired)})

    counts = feedback.select("feedback_type").mapInPandas(counted, "feedback_type string, n long")
    return counts.groupBy("feedback_type").applyInPandasWithState(
        step, TRIGGER_SCHEMA, COUNT_STATE, "append", GroupStateTimeout.NoTimeout)


def retrain_triggers_batch(feedback: DataFrame, threshold: int = RETRAIN_THRESHOLD) -> DataFrame:
    """W4 (batch twin): the same trigger rows from the final counts."""
    g = feedback.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("total"))
    return (g.withColumn("fired_at_count", F.explode(F.when(F.col("total") >= threshold, F.sequence(
        F.lit(threshold).cast("long"), (F.floor(F.col("total") / threshold) * threshold).cast("long"),
        F.lit(threshold).cast("long"))).otherwise(F.array().cast("array<long>"))))
            .select("feedback_type", "fired_at_count", F.col("total").cast("long")))


# ---------------------------------------------------- W5 repeat suppression
def suppress_repeats(questions: DataFrame, watermark: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """Drop a question whose cleaned text was already seen within the
    watermark delay."""
    h = questions.withColumn("query_hash", context.query_hash(TX.clean("text")))
    if h.isStreaming:
        return h.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["query_hash"])
    # Batch twin: a question stays if the last kept one of its hash is at least
    # the delay older.  Equal (hash, time) rows are one row before the shuffle;
    # the rest streams through in time order, one time per hash in memory.
    delay = pd.Timedelta(seconds=_seconds(watermark))
    row = F.struct(*h.columns)
    first = h.groupBy("query_hash", F.col(ts).alias("_ts")).agg(F.min_by(row, F.to_json(row)).alias("_r"))
    times = (first.select("query_hash", "_ts").repartition("query_hash").sortWithinPartitions("query_hash", "_ts"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_hash, last = None, None
        for batch in batches:
            keep = []
            for key, at in zip(batch["query_hash"], batch["_ts"]):
                new = key != last_hash or last is None or pd.isna(at) or at - last >= delay
                keep.append(new)
                if new:
                    last_hash, last = key, None if pd.isna(at) else at
            yield batch[keep]

    stay = times.mapInPandas(kept, times.schema)
    same = [first["query_hash"] == stay["query_hash"], first["_ts"].eqNullSafe(stay["_ts"])]
    return first.join(stay, same, "left_semi").select("_r.*")


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(n) * mult


# ---------------------------------------------------- W1 / W6 foreachBatch
def _epoch_writer(base: str, build):
    def write(batch: DataFrame, epoch: int) -> None:
        out = build(batch)
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")

    return write


def start_routing(questions: DataFrame, kb: DataFrame, out_dir: str, checkpoint: str | None = None,
                  trigger_once: bool = True):
    """Every micro-batch of questions (query_id, text, vector) runs the batch
    answer plan; query, retrieval and response logs are written per epoch and the
    batch's cached frames are released.  ``kb`` may be a function that returns
    (KB rows, BM25 index) and is asked again for each micro-batch, so new rows
    are found."""
    from ..operators import bm25
    from ..plans import end_to_end

    spark = questions.sparkSession
    if callable(kb):
        current = kb
    else:
        fixed = (kb, bm25.build_index(kb.filter(F.col("is_active")).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))))
        current = lambda: fixed

    def build(batch: DataFrame) -> dict[str, DataFrame]:
        rows, index = current()
        res = end_to_end.answer(batch, rows, index)
        held.append(res)
        q = res.queries.select("query_id", "route", "reason", "confidence", "retrieval_count",
                               F.col("sentiment.label").alias("sentiment"))
        h = res.hits.select("query_id", "doc_id", "rank", "combined_score")
        r = res.queries.filter(F.col("response_text").isNotNull()).select("query_id", "response_text", "generated_by")
        return {"queries": q, "retrievals": h, "responses": r}

    held: list = []
    write = _epoch_writer(out_dir, build)

    def write_and_release(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch, epoch)
        finally:
            while held:
                held.pop().release()

    w = questions.writeStream.foreachBatch(write_and_release).option(
        "checkpointLocation", checkpoint or scratch_path(spark, f"w1-routing-{uuid.uuid4().hex}"))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def start_ingest(articles: DataFrame, kb_base: str, kb: DataFrame, as_of, checkpoint: str | None = None,
                 on_increment: Callable[[DataFrame, int], None] | None = None):
    """Each micro-batch of articles is ingested (ids after the current max
    over the base KB and every earlier increment) and written as its own
    increment directory; the KB is the base plus all increments.

    A retried epoch does not see its own earlier output, so its ids stay the
    same.  Increments of another checkpoint are never overwritten: a stream with
    a fresh checkpoint has its own ``stream=`` folder and continues after all
    others.  ``on_increment(rows, epoch)`` gets each written increment, for
    example to ``bm25.upsert_documents`` into an index."""
    spark = articles.sparkSession
    where = checkpoint or scratch_path(spark, f"w6-ingest-{uuid.uuid4().hex}")
    return (articles.writeStream.foreachBatch(ingest_writer(kb_base, kb, as_of, where, on_increment))
            .option("checkpointLocation", where).trigger(availableNow=True).start())


def ingest_writer(kb_base: str, kb: DataFrame, as_of, checkpoint: str,
                  on_increment: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of ``start_ingest``."""
    from ..sources import kb as KB

    spark = kb.sparkSession
    own = f"stream={hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def earlier(epoch: int) -> list[str]:
        found = []
        for stream in _folders(spark, kb_base, "stream="):
            for name in _folders(spark, f"{kb_base}/{stream}", "epoch="):
                if stream != own or int(name.split("=")[1]) < epoch:
                    found.append(f"{kb_base}/{stream}/{name}")
        return found

    def write(batch: DataFrame, epoch: int) -> None:
        paths = earlier(epoch)
        current = kb.select("id")
        if paths:
            current = current.unionByName(spark.read.parquet(*paths).select("id"))
        to = f"{kb_base}/{own}/epoch={epoch}"
        KB.ingest(current, batch, as_of).write.mode("overwrite").parquet(to)
        if on_increment is not None:
            on_increment(spark.read.parquet(to), epoch)

    return write


def _folders(spark, path: str, prefix: str) -> list[str]:
    """Names of the folders below ``path`` that start with ``prefix`` (none where
    ``path`` does not exist; any other error is raised)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def event_source_dir(sf_dir: str) -> str:
    """The directory to stream ``events.parquet`` from (glob-filtered)."""
    return sf_path(sf_dir, "events").rsplit("/", 1)[0]
