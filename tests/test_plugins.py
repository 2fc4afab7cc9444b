"""Every plug-in point with a small model of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmsman import plugins
from helmsman.config import PiiParams
from helmsman.functions import pii
from helmsman.operators import bm25


def _texts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def test_embedder_normalises_and_checks(spark):
    encode = lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = plugins.batched_embedder(encode, 2, batch_size=2)(_texts(spark, "a", "bb", "cccc")).collect()
    assert [r["embedding"] for r in sorted(got, key=lambda r: r["query_id"])] == [
        pytest.approx(list(v / np.linalg.norm(v)), abs=1e-6) for v in np.array([[1, 1], [2, 1], [4, 1]], float)]
    with pytest.raises(Exception, match="embedding dimension"):
        plugins.batched_embedder(encode, 3)(_texts(spark, "a")).collect()
    with pytest.raises(Exception, match="empty text"):
        plugins.batched_embedder(encode, 2)(_texts(spark, None)).collect()


def test_sentiment_model_labels(spark):
    classify = lambda texts: [("POSITIVE", 0.9) if "good" in t else ("LABEL_NEG", 0.8) if "bad" in t else ("x", 0.6) for t in texts]
    df = _texts(spark, "good", "bad", "so so", "", None)
    got = df.select("query_id", plugins.sentiment_model(classify)(F.col("text")).alias("s")).orderBy("query_id").collect()
    assert [(r["s"]["label"], r["s"]["score"]) for r in got] == [
        ("positive", 0.9), ("negative", 0.8), ("neutral", 0.6), ("neutral", 0.5), ("neutral", 0.5)]


def test_generator_names_itself(spark):
    df = spark.createDataFrame([(1, "p one", "c")], "query_id long, prompt string, context string")
    run = plugins.generator(lambda prompts: [p.upper() for p in prompts], "upper")
    got = df.mapInPandas(run, "query_id long, response_text string, generated_by string").collect()
    assert [tuple(r) for r in got] == [(1, "P ONE", "upper")]


def test_bm25_uses_the_tokenizer_of_its_index(spark):
    docs = _texts(spark, "red,green", "green,blue", "black").withColumnRenamed("query_id", "doc_id")
    commas = plugins.tokenizer(lambda t: [w for w in t.split(",") if w])
    index = bm25.build_index(docs, tokenizer=commas)
    hits = bm25.search(index, _texts(spark, "red,black"), k=5).collect()
    assert {r["doc_id"] for r in hits} == {0, 2}
    more = spark.createDataFrame([(9, "pink,red")], "doc_id long, text string")
    assert {r["doc_id"] for r in bm25.search(bm25.upsert_documents(index, more), _texts(spark, "pink"), k=5).collect()} == {9}


def test_recognisers_extend_detection_and_redaction(spark):
    params = PiiParams(recognisers=(("ORDER_ID", "ORD-[0-9]{4}", 0.7, "[ORDER]"), ("HANDLE", "@[a-z]+", 0.5, "[HANDLE]")))
    df = spark.createDataFrame([("John: ORD-1234, a@b.org and @anna",)], "t string")
    row = df.select(pii.redact("t", params).alias("r"), pii.spans("t", params).alias("s"), pii.has_pii(F.lit("ORD-9999"), params).alias("h")).first()
    assert row["r"] == "[NAME]: [ORDER], [EMAIL] and [HANDLE]" and row["h"]
    assert [(s["entity_type"], s["score"]) for s in row["s"]] == [("PERSON", 1.0), ("ORDER_ID", 0.7), ("EMAIL_ADDRESS", 1.0), ("HANDLE", 0.5)]
