"""Formula, invariant and brute-force tests on small literal inputs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helmsman.config import Bm25Params, CleanParams, DecisionParams, HybridParams, PiiParams
from helmsman.functions import pii
from helmsman.functions import text as T
from helmsman.operators import bm25, context, decision, fusion, knn, numbering


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


# ---------------------------------------------------------------- cleaning
def test_clean_worked_example(spark):
    got = one(spark, T.clean("t"), "Hi!!! I need   help with my <b>password</b>. Pls help!")
    assert got == "Hi! I need help with my password. please help!"


def test_clean_null_and_disabled(spark):
    assert one(spark, T.clean("t"), None) == ""
    assert one(spark, T.clean("t", CleanParams(enabled=False)), "a  <b>b</b>") == "a  <b>b</b>"


def test_markdown_and_punctuation(spark):
    assert one(spark, T.clean("t"), "see [the docs](http://x.y/z) *now* wow?!..") == "see the docs now wow."


def test_bm25_tokens_keep_punctuation(spark):
    assert one(spark, T.bm25_tokens("t"), "  Reset my PASSWORD, please!\n") == ["reset", "my", "password,", "please!"]


# --------------------------------------------------------------------- PII
def test_redact_replace(spark):
    got = one(spark, pii.redact("t"), "My email is john.doe@gmail.com and my card is 4111111111111111")
    assert got == "My email is [EMAIL] and my card is [CREDIT_CARD]"


def test_luhn_invalid_card_is_kept(spark):
    assert one(spark, pii.redact("t"), "number 4111111111111112 here") == "number 4111111111111112 here"


def test_redaction_idempotent(spark):
    s = "Call +1 (555) 123-4567 or mail a.b@c.org, ssn 123-45-6789, ask John"
    once = one(spark, pii.redact("t"), s)
    assert "[PHONE]" in once and "[EMAIL]" in once and "[SSN]" in once and "[NAME]" in once
    assert one(spark, pii.redact("t"), once) == once


def test_mask_and_hash(spark):
    m = one(spark, pii.redact("t", PiiParams(strategy="mask")), "x a.b@c.org y")
    assert m == "x " + "*" * len("a.b@c.org") + " y"
    h = one(spark, pii.redact("t", PiiParams(strategy="hash")), "x a.b@c.org y")
    assert h == "x " + pii.sha256_hex("a.b@c.org") + " y"
    u = one(spark, pii.redact("t", PiiParams(strategy="other")), "x a.b@c.org y")
    assert u == "x [REDACTED] y"


def test_mask_and_hash_replace_spans_only(spark):
    import hashlib

    s = "Mr Johnson met John, a@b.org and 4111111111111111; x4111111111111111y Éva John"
    mask = one(spark, pii.redact("t", PiiParams(strategy="mask")), s)
    assert mask == "Mr Johnson met ****, ******* and " + "*" * 16 + "; x" + "*" * 16 + "y Éva ****"
    digest = {v: hashlib.sha256(v.encode()).hexdigest() for v in ("John", "a@b.org", "4111111111111111")}
    want = s.replace("met John", "met " + digest["John"]).replace("Éva John", "Éva " + digest["John"])
    for v in ("a@b.org", "4111111111111111"):
        want = want.replace(v, digest[v])
    assert one(spark, pii.redact("t", PiiParams(strategy="hash")), s) == want


def test_span_offsets(spark):
    s = "mail a.b@c.org now"
    spans = spark.createDataFrame([(s,)], "t string").select(pii.spans("t").alias("x")).first()["x"]
    assert [(r["entity_type"], s[r["start"]:r["end"]]) for r in spans] == [("EMAIL_ADDRESS", "a.b@c.org")]


# ----------------------------------------------------------------- BM25
def _index(spark, docs):
    return bm25.build_index(spark.createDataFrame(docs, "doc_id long, text string"))


def _rank_bm25_reference(corpus, query, k1=1.5, b=0.75, eps=0.25):
    """Plain-Python Okapi BM25 with the IDF floor (test oracle)."""
    toks = [c.lower().split() for c in corpus]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: (eps * avg if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in query.lower().split():
            tf = t.count(q)
            s += idf.get(q, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))
        out.append(s)
    return out


def test_bm25_matches_reference_formula_with_floor_and_duplicates(spark):
    corpus = ["the cat sat", "the dog sat on the mat", "the the the", "a cat and a dog", "", "mat"]
    idx = _index(spark, list(enumerate(corpus)))
    assert idx.n_docs == 6
    q = "the cat cat mat"
    exp = _rank_bm25_reference(corpus, q)
    got = {r["doc_id"]: r["score"] for r in bm25.scores(idx, spark.createDataFrame([(1, q)], "query_id long, text string")).collect()}
    for i, e in enumerate(exp):
        assert got.get(i, 0.0) == pytest.approx(e, abs=1e-9)
    # "the" occurs in 3 of 6 documents: raw idf is 0, and in 4 -> negative -> floored
    assert any(r["idf"] > 0 for r in idx.terms.collect())


def test_bm25_topk_positive_only_and_guards(spark):
    idx = _index(spark, [(1, "alpha beta"), (2, "beta gamma"), (3, "delta")])
    qs = spark.createDataFrame([(10, "beta"), (11, ""), (12, "zeta")], "query_id long, text string")
    hits = bm25.search(idx, qs, k=5).collect()
    assert {(h["query_id"], h["doc_id"]) for h in hits} == {(10, 1), (10, 2)}
    assert sorted(h["rank"] for h in hits) == [1, 2]


def test_bm25_update_and_remove(spark):
    filler = [(10 + i, f"filler{i} common") for i in range(8)]
    idx = _index(spark, [(1, "alpha beta"), (2, "beta gamma"), (3, "delta")] + filler)
    idx2 = bm25.update_documents(idx, spark.createDataFrame([(3, "alpha alpha"), (9, "ghost")], "doc_id long, text string"))
    assert idx2.n_docs == 11
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert {r["doc_id"] for r in bm25.search(idx2, q).collect()} == {1, 3}
    idx3 = bm25.remove_documents(idx2, spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert idx3.n_docs == 9
    assert bm25.search(idx3, q).count() == 0


# ------------------------------------------------------------------ vectors
def test_topk_kernel_matches_brute_force():
    rng = np.random.default_rng(3)
    q = rng.normal(size=(7, 5))
    d = rng.normal(size=(300, 5))
    d[17] = d[3]  # an exact tie
    ids = np.arange(1000, 1300)
    top = knn.TopK(7, 4)
    for i in range(0, 300, 37):
        top.add(np.round(q @ d[i:i + 37].T, 6), ids[i:i + 37])
    top.prune()
    full = np.round(q @ d.T, 6)
    for r in range(7):
        order = sorted(range(300), key=lambda j: (-full[r, j], ids[j]))[:4]
        kept = set(top.ids[top.r == r])
        assert set(ids[order]) <= kept


def test_knn_self_similarity_and_ranks(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    kb = spark.createDataFrame(vecs, "id long, embedding array<float>")
    qs = spark.createDataFrame(vecs[:5], "query_id long, vector array<float>")
    hits = knn.search(kb, qs, k=3).collect()
    for qid in range(5):
        rows = sorted((h for h in hits if h["query_id"] == qid), key=lambda h: h["rank"])
        assert [h["rank"] for h in rows] == [1, 2, 3]
        assert rows[0]["doc_id"] == qid and rows[0]["score"] == pytest.approx(1.0, abs=1e-6)


def test_knn_blocked_path_equals_broadcast(spark):
    from helmsman.config import VectorParams

    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    kb = spark.createDataFrame(vecs, "id long, embedding array<float>")
    qs = spark.createDataFrame(vecs[:30], "query_id long, vector array<float>")
    a = {tuple(r) for r in knn.search(kb, qs, k=4).collect()}
    b = {tuple(r) for r in knn.search(kb, qs, k=4, params=VectorParams(broadcast_max_bytes=0, block_rows=16)).collect()}
    assert a == b


# ------------------------------------------------------------------ fusion
def test_rrf_missing_side_scores_zero(spark):
    b = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], "query_id long, doc_id long, score double, rank long")
    v = spark.createDataFrame([(1, 12, 0.9, 1), (1, 10, 0.8, 2)], "query_id long, doc_id long, score double, rank long")
    out = {r["doc_id"]: r for r in fusion.cut(fusion.rrf(b, v, 0.5), 5).collect()}
    assert out[10]["combined_score"] == pytest.approx(round(0.5 / 62 + 0.5 / 61, 6))
    assert out[11]["semantic_score"] == 0.0 and out[12]["bm25_score"] == 0.0
    assert max(r["combined_score"] for r in out.values()) <= 1 / 61 + 1e-9
    assert [out[d]["rank"] for d in (10, 12, 11)] == [1, 2, 3]


# --------------------------------------------------------------- decisions
@pytest.mark.parametrize("scores,expected", [
    ([], 0.0),
    ([0.9], 0.4 * 0.9 + 0.3 * 1.0 + 0.3 * (1 / 3)),
    ([0.5, 0.5], 0.4 * 0.5 + 0.3 * 1.0 + 0.3 * (2 / 3)),
    ([0.6, 0.3, 0.1], 0.4 * 0.6 + 0.3 * max(0, 1 - np.std([0.6, 0.3, 0.1]) / (np.mean([0.6, 0.3, 0.1]) + 1e-9))
     + 0.3 * (2 / 3)),
])
def test_confidence_cases(spark, scores, expected):
    hits = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)] or [(2, 1, 0.0)],
                                 "query_id long, rank long, combined_score double")
    if not scores:
        hits = hits.filter("query_id = 1")
    qs = spark.createDataFrame([(1,)], "query_id long")
    got = decision.confidence(hits, qs).first()["confidence"]
    assert got == pytest.approx(expected, abs=1e-9)
    assert 0.0 <= got <= 1.0


def test_topics_worked_example(spark):
    t = one(spark, decision.sensitive_topics("t"), "I want a refund for my credit card charge")
    assert t["has_sensitive"] and t["topics"] == ["payment"] and t["confidence"] == pytest.approx(0.6)


def test_route_rule_order(spark):
    df = spark.createDataFrame([(0.9, "negative", True, True), (0.9, "positive", True, True),
                                (0.9, "positive", False, False), (0.1, "negative", True, True)],
                               "c double, s string, u boolean, h boolean")
    reasons = [r["r"] for r in df.select(decision.route_reason("c", "s", "u", "h").alias("r")).collect()]
    assert reasons == ["negative_sentiment", "sensitive_topic", "default_auto_response", "low_confidence"]
    off = DecisionParams(auto_enabled=False)
    assert df.select(decision.route_reason("c", "s", "u", "h", off).alias("r")).first()["r"] == "auto_response_disabled"
    urgent = DecisionParams(handoff_reasons=("urgent",))
    assert df.select(decision.route_reason("c", "s", "u", "h", urgent).alias("r")).first()["r"] == "urgency_detected"


def test_prompt_keeps_braces(spark):
    df = spark.createDataFrame([("q {context}", "ctx {question}")], "q string, c string")
    p = df.select(context.build_prompt("q", "c").alias("p")).first()["p"]
    assert "ctx {question}" in p and "Customer Question: q {context}" in p


# --------------------------------------------------------------- numbering
def test_assign_ids_is_dense_and_ordered(spark):
    rows = [(f"t{random.Random(i).randint(0, 50)}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "term string, n long")
    ids = numbering.assign_ids(df, [F.col("term").asc(), F.col("n").asc()], start=4).orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(4, 504))
    assert [(r["term"], r["n"]) for r in ids] == sorted(rows)


def test_exact_quantiles_with_hot_group(spark):
    rng = np.random.default_rng(5)
    vals = [("hot", float(x)) for x in rng.normal(size=3000)] + [("cold", float(x)) for x in rng.normal(size=7)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in numbering.exact_quantiles(df, "v", [0.0, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in ("hot", "cold"):
        xs = np.array([v for k, v in vals if k == g])
        for q in (0.0, 0.5, 0.95, 1.0):
            assert got[(g, q)] == pytest.approx(float(np.quantile(xs, q)), abs=1e-12)


def _tile_case(n_docs, n_terms, n_questions, seed):
    """Random postings (doc, t, w), repeated rows and copies among them, and question
    entries with positive, zero and negative weights."""
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n_docs, n_terms)) < 0.3 / (1 + np.arange(n_terms) % 7), rng.random((n_docs, n_terms)) + 0.2, 0.0)
    w[n_docs // 2: n_docs // 2 + 40] = w[n_docs // 2]  # a group of copies
    entries = rng.random((n_questions, n_terms)) < 0.2
    weight = np.where(entries, rng.choice([-0.3, 0.0, 0.4, 2.0, 5.0], (n_questions, n_terms)), 0.0)
    doc, t = np.nonzero(w)
    q, qt = np.nonzero(entries)
    return w, weight, (doc, t, w[doc, t]), (np.arange(n_questions) * 10, q, qt, weight[q, qt], n_terms)


@pytest.mark.parametrize("with_floors", [False, True])
def test_block_max_top_k_equals_all_scores(with_floors, monkeypatch):
    monkeypatch.setattr(bm25, "MAX_PRODUCTS", 300)
    monkeypatch.setattr(bm25, "MAX_CELLS", 2_000)
    k = 5
    w, weight, (doc, t, value), block = _tile_case(400, 30, 25, 3)
    scores = weight @ w.T
    floors = np.maximum(0.0, -np.sort(-scores[:, :100], axis=1)[:, k - 1]) if with_floors else None
    tiles = bm25._query_tiles(block, floors, k)
    split = int(np.searchsorted(doc, 150))
    read = sum(bm25._score_documents(doc[a:b], t[a:b], value[a:b], tiles) for a, b in ((0, split), (split, len(doc))))
    top = tiles[0].top
    found = {(int(q), int(d)): s for q, d, s in zip(top.r, top.ids, top.s)}
    for q in range(len(weight)):
        best = sorted((-round(x, 9), d) for d, x in enumerate(scores[q]) if x > 1e-9)[:k]
        for s, d in best:
            assert found[(q, d)] == pytest.approx(-s, abs=1e-9)
        assert sum(1 for q2, _ in found if q2 == q) <= 3 * k  # copies do not pile up
    everything = int(sum(np.count_nonzero(w[:, term]) for _, term in zip(block[1], block[2])))
    assert read < everything * (0.8 if with_floors else 1.0)


def test_repeated_document_ids_score_together():
    block = (np.array([7]), np.array([0, 0]), np.array([0, 1]), np.array([1.0, 2.0]), 2)
    tiles = bm25._query_tiles(block, np.array([2.5]), 1)
    bm25._score_documents(np.array([4, 4, 4, 9]), np.array([1, 0, 1, 1]), np.array([0.5, 1.0, 1.0, 1.0]), tiles)
    assert list(zip(tiles[0].top.ids, tiles[0].top.s)) == [(4, 4.0)]


def test_top_k_of_copies_keeps_the_smallest_ids():
    top = knn.TopK(1, 3)
    top.add(np.full((1, 1000), 0.5), np.arange(1000, 0, -1))
    top.prune()
    assert sorted(top.ids) == [1, 2, 3]


def test_pruned_bm25_topk_equals_exhaustive(spark):
    from helmsman.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    idx = bm25.build_index(docs)
    for qs, k in ((fx.user_questions(spark, SF_SMALL), 5), (fx.vector_questions(spark, SF_SMALL), 10)):
        a = {tuple(r) for r in bm25.search(idx, qs, k=k, prune=True).collect()}
        b = {tuple(r) for r in bm25.search(idx, qs, k=k, prune=False).collect()}
        assert a == b and a
    allowed = docs.filter("doc_id % 3 = 0").select("doc_id")
    qs = fx.user_questions(spark, SF_SMALL)
    a = {tuple(r) for r in bm25.search(idx, qs, k=5, allowed_docs=allowed, prune=True).collect()}
    b = {tuple(r) for r in bm25.search(idx, qs, k=5, allowed_docs=allowed, prune=False).collect()}
    assert a == b


@pytest.mark.parametrize("partitions", ["3", "8", "16"])
def test_saved_bucketed_index_equals_fresh(spark, scratch, partitions):
    """Loaded under other partition settings than it was saved with."""
    from helmsman.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    docs = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    idx = bm25.build_index(docs)
    table = f"test_bm25_postings_{partitions}"
    bm25.save_index(idx, scratch, table, buckets=4)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        idx2 = bm25.load_index(spark, scratch, table)
        assert idx2.postings.select("doc_id").distinct().count() == idx.postings.select("doc_id").distinct().count()
        assert idx2.postings.count() == idx.postings.count()
        assert (idx2.n_docs, idx2.avgdl) == (idx.n_docs, idx.avgdl)
        assert idx2.avg_idf == pytest.approx(idx.avg_idf, abs=1e-12)
        qs = fx.user_questions(spark, SF_SMALL)
        a = {tuple(r) for r in bm25.search(idx, qs, k=5).collect()}
        b = {tuple(r) for r in bm25.search(idx2, qs, k=5).collect()}
        assert a == b and a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_saved_index_refuses_another_layout_or_parameters(spark, scratch):
    from helmsman.config import Bm25Params

    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(20)], "doc_id long, text string")
    bm25.save_index(bm25.build_index(docs), scratch, "test_bm25_refused", buckets=4)
    with pytest.raises(ValueError):
        bm25.load_index(spark, scratch, "test_bm25_refused", Bm25Params(k1=2.0))
    spark.sql("DROP TABLE test_bm25_refused")
    spark.sql(f"CREATE TABLE test_bm25_refused (doc_id BIGINT, dl INT, term STRING, tf BIGINT) USING parquet "
              f"CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO 8 BUCKETS LOCATION '{scratch}/postings'")
    with pytest.raises(ValueError):
        bm25.load_index(spark, scratch, "test_bm25_refused")


def test_upsert_adds_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(20)], "doc_id long, text string")
    more = spark.createDataFrame([(3, "changed text"), (99, "new words")], "doc_id long, text string")
    index = bm25.upsert_documents(bm25.build_index(docs), more)
    whole = bm25.build_index(docs.where("doc_id <> 3").unionByName(more))
    assert (index.n_docs, index.avgdl) == (whole.n_docs, whole.avgdl)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, whole.postings.collect()))


def test_ids_are_dense_and_unique_with_all_columns(spark):
    """The numbered rows carry columns outside the sort key."""
    from pyspark.sql import functions as F

    from helmsman.operators.numbering import assign_ids

    rows = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), F.concat(F.lit("payload "), "id").alias("payload"),
                                      F.create_map(F.lit("a"), F.col("id").cast("string")).alias("m"))
    out = assign_ids(rows.repartition(7), [F.col("k")], start=11)
    assert tuple(out.agg(F.min("id"), F.max("id"), F.countDistinct("id"), F.countDistinct("payload")).first()) == (11, 30_010, 30_000, 30_000)
    assert out.join(out.select((F.col("id") + 1).alias("id"), F.col("k").alias("before")), "id").where("k < before").count() == 0


def test_saved_language_profile_detects_the_same(spark, scratch):
    from helmsman.operators import language
    from helmsman.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    docs = fx.table(spark, SF_SMALL, "documents")
    prof = language.train(docs.select("text", "lang"))
    language.save_profile(prof, scratch + "/profile")
    prof2 = language.load_profile(spark, scratch + "/profile")
    assert prof2.unseen == pytest.approx(prof.unseen)
    a = {tuple(r) for r in language.detect(docs, prof, "doc_id", "text").collect()}
    b = {tuple(r) for r in language.detect(docs, prof2, "doc_id", "text").collect()}
    assert a == b and a


def test_hybrid_search_disabled_and_empty_question(spark):
    from helmsman.config import HybridParams
    from helmsman.operators import fusion
    from helmsman.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    kb = fx.knowledge_base(spark, SF_SMALL)
    index = bm25.build_index(kb.select(fx.F.col("id").alias("doc_id"), fx.F.col("content").alias("text")))
    qs = fx.vector_questions(spark, SF_SMALL).limit(3)
    on = fusion.search(index, kb, qs.withColumn("text", fx.F.lit("  ")))
    off = fusion.search(index, kb, qs, HybridParams(enabled=False))
    assert on.count() == 0 and off.count() == 0 and set(off.columns) == set(on.columns)


def test_vectors_of_another_length_are_rejected(spark):
    from helmsman.operators import knn

    kb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0, 1.0])], "id long, embedding array<float>")
    qs = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0])], "query_id long, vector array<float>")
    got = knn.search(kb, qs, 2, active_only=False).collect()
    assert [(r["query_id"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(10, 1), (10, 2)]
    assert sorted(map(tuple, knn.rejects(kb, 2).collect())) == [(3, 1), (5, 3)]


def test_knn_tiles_do_not_change_the_result(spark, monkeypatch):
    import numpy as np

    from helmsman.operators import knn

    rng = np.random.default_rng(4)
    q, d = rng.normal(size=(37, 8)), rng.normal(size=(300, 8))
    d[10] = d[20]

    def top(tile):
        monkeypatch.setattr(knn, "QUERY_TILE", tile)
        monkeypatch.setattr(knn, "MAX_SCORE_CELLS", tile * 16)
        tiles = knn.Tiles(np.arange(37), q, 5)
        for i in range(0, 300, 70):
            tiles.add(d[i:i + 70], np.arange(i, min(i + 70, 300)))
        return {(int(a), int(b)) for f in tiles.frames() for a, b in zip(f.query_id, f.doc_id)}

    scores = q @ d.T
    want = {(i, int(j)) for i in range(37) for j in np.flatnonzero(scores[i] >= np.sort(scores[i])[-5] - knn.TIE_TOL)}
    assert top(8) == top(2048) == want


def test_duplicate_and_empty_updates(spark):
    import datetime as dt

    from helmsman.sources import fixtures as fx
    from helmsman.sources import kb as KB
    from tests.conftest import SF_SMALL

    kb = fx.knowledge_base(spark, SF_SMALL)
    updates = spark.createDataFrame([(1, "new a"), (1, "new b"), (2, None), (10**9, "unknown")], "id long, content string")
    out = KB.update(kb, updates, dt.datetime(2030, 1, 1))
    assert out.count() == kb.count()
    changed = {r["id"]: r["content"] for r in out.where("updated_at > '2029-01-01'").collect()}
    assert changed == {1: "new b"}
    assert KB.update(kb, updates.select("id"), dt.datetime(2030, 1, 1)).where("updated_at > '2029-01-01'").count() == 0


def test_many_blocks_of_questions_give_the_hits_and_scores_of_one(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    corpus = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(40)], k=rnd.randrange(0, 30)))) for i in range(300)]
    corpus += [(1000 + i, corpus[7][1] or "w1 w2") for i in range(60)] + [(2000, None), (2001, "")]
    qs = spark.createDataFrame([(i, t) for i, t in corpus[::5]] + [(5000, None), (None, "w1 w3")], "query_id long, text string")
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    one, many = (bm25.build_index(docs, params=Bm25Params(query_max_bytes=size)) for size in (64 << 20, 3_000))
    assert len(list(bm25._question_blocks(many, qs.where("query_id is not null")))) > 5
    hits = [sorted(tuple(r) for r in bm25.search(x, qs, k=4).select("query_id", "doc_id", "score", "rank").collect()) for x in (one, many)]
    assert hits[0] == hits[1] and len(hits[0]) > 200
    # every pair that shares a term, from the postings themselves
    qt = bm25.query_terms(qs).join(one.terms, "term").join(one.postings, "term")
    want = {(r["query_id"], r["doc_id"]): r["s"] for r in qt.groupBy("query_id", "doc_id").agg(F.sum(F.expr("qtf * idf * w")).alias("s")).collect()}
    for x in (one, many):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.scores(x, qs).collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert any(q is None for q, _ in want)


def test_positive_scores_are_counted_where_they_are_made(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randrange(0, 25)))) for i in range(200)]
    corpus += [(3, "w1 w2 w50"), (None, "w5 w7"), (300, None), (301, "")]
    qs = spark.createDataFrame([(i, t) for i, t in corpus[::4]] + [(5000, None), (None, "w1 w3"), (6000, "unknown")], "query_id long, text string")
    for size in (64 << 20, 2_000):
        index = bm25.build_index(spark.createDataFrame(corpus, "doc_id long, text string"), params=Bm25Params(query_max_bytes=size))
        want = {r["query_id"]: r["count"] for r in bm25.scores(index, qs).where("score > 0").groupBy("query_id").count().collect()}
        got = {r["query_id"]: r["n"] for r in bm25.scores(index, qs, counted=True).collect()}
        assert got == want and len(got) > 40
    assert bm25.scores(index, qs.where("query_id = 6000"), counted=True).collect() == []


@pytest.mark.parametrize("cost", [0, 10**9])
def test_set_aside_entries_meet_their_postings_where_many_documents_come_near(cost, monkeypatch):
    monkeypatch.setattr(bm25, "DENSE_SHARE", 10.0)  # no matrix product
    monkeypatch.setattr(bm25, "LOOKUP_COST", cost)
    monkeypatch.setattr(bm25, "MAX_CELLS", 1_000)
    w, weight, (doc, t, value), block = _tile_case(400, 30, 25, 8)
    scores = weight @ w.T
    tiles = bm25._query_tiles(block, np.maximum(0.0, -np.sort(-scores[:, :100], axis=1)[:, 4]), 5)
    read = bm25._score_documents(doc, t, value, tiles)
    found = {(int(q), int(d)): s for q, d, s in zip(tiles[0].top.r, tiles[0].top.ids, tiles[0].top.s)}
    for q in range(len(weight)):
        for s, d in sorted((-round(x, 9), d) for d, x in enumerate(scores[q]) if x > 1e-9)[:5]:
            assert found[(q, d)] == pytest.approx(-s, abs=1e-9)
    everything = int(sum(np.count_nonzero(w[:, term]) for _, term in zip(block[1], block[2])))
    assert read == everything and tiles[0].pause > 1 if cost else read < everything and tiles[0].pause == 1


@pytest.mark.parametrize("wide", [False, True])
def test_buckets_of_few_and_many_pairs_above_the_floor(wide, monkeypatch):
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1)[:, None])(rng.normal(size=(n, 6)))
    q, d = unit(30), unit(500)
    qb, db = (rng.integers(0, 4, (n, 2)) + (1000 if wide else 0) for n in (30, 500))
    qb, db = (knn._buckets(pa.table({"buckets": pa.array(x.tolist(), pa.list_(pa.int64()))})) for x in (qb, db))
    assert qb.dtype == (np.int64 if wide else np.int8)
    scores = np.where((qb[:, None, :] == db[None]).any(axis=2), q @ d.T, -np.inf)
    want = {(i, int(j)) for i in range(30) for j in np.flatnonzero(scores[i] >= np.sort(scores[i])[-3] - knn.TIE_TOL)}
    for few in (0, 2, 10**9):
        monkeypatch.setattr(knn, "FEW", few)
        tiles = knn.Tiles(np.arange(30), q, 3, qb)
        for i in range(0, 500, 90):
            tiles.add(d[i:i + 90], np.arange(i, min(i + 90, 500)), db[i:i + 90])
        assert {(int(a), int(b)) for f in tiles.frames() for a, b in zip(f.query_id, f.doc_id)} == want


def test_an_updated_index_outlives_the_one_it_came_from(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(40)], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "gamma"), (2, "w5"), (3, "w7 alpha")], "query_id long, text string")
    hits = lambda x: sorted(tuple(r) for r in bm25.search(x, qs, k=2).collect())
    old = bm25.build_index(docs)
    new = bm25.update_documents(old, spark.createDataFrame([(5, "gamma delta")], "doc_id long, text string"))
    before = hits(new)
    assert [df.is_cached for df in old.cached] == [True, True]
    old.release()
    assert not any(df.is_cached for df in old.cached) and all(df.is_cached for df in new.cached)
    assert hits(new) == before and [d for q, d, *_ in before if q == 1] == [5]


def test_the_best_of_a_block_are_the_floor_of_the_next():
    rng = np.random.default_rng(2)
    scores, top = rng.random((20, 600)), knn.TopK(20, 5)
    for at in range(0, 600, 200):
        top.add(scores[:, at:at + 200], np.arange(at, at + 200))
        assert (top.floor == np.sort(scores[:, :200], axis=1)[:, -5]).all() or at
        assert (top.floor <= np.sort(scores, axis=1)[:, -5]).all()
    top.prune()
    want = {(i, int(j)) for i in range(20) for j in np.flatnonzero(scores[i] >= np.sort(scores[i])[-5] - knn.TIE_TOL)}
    assert set(zip(top.r.tolist(), top.ids.tolist())) == want


def test_question_terms_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(40)], "doc_id long, text string")
    index = bm25.build_index(docs)
    plans, persist = [], type(docs).persist

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().toString())
        return persist(df, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(docs), "persist", seen)
        blocks = list(bm25._question_blocks(index, docs.select(F.col("doc_id").alias("query_id"), "text")))
    assert len(blocks) == 1 and len(blocks[0].ids) == 40
    assert any("qw" in p for p in plans) and not any("ResolvedHint" in p or "strategy=broadcast" in p for p in plans)


def test_a_search_joins_and_sorts_no_postings(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(40)], "doc_id long, text string")
    index = bm25.build_index(docs)
    (block,) = bm25._question_blocks(index, docs.select(F.col("doc_id").alias("query_id"), "text"))
    plan = bm25._postings_of(index, block, None)._jdf.queryExecution().executedPlan().toString()
    searched = plan.split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in searched and "Window" in searched
    assert not any(x in searched for x in ("Join", "Exchange", "Sort"))


def test_terms_with_one_hash_get_another_salt(spark, monkeypatch):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices([f"w{j}" for j in range(50)], k=12))) for i in range(80)], "doc_id long, text string")
    qs = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "text")
    hits = lambda: sorted(tuple(r) for r in bm25.search(bm25.build_index(docs), qs, k=4).collect())
    want, exact = hits(), bm25._hash
    # the first two salts give words of one length one hash
    monkeypatch.setattr(bm25, "_hash", lambda salt: exact(salt) if salt > 1 else F.length("term").cast("long"))
    assert bm25._salt(bm25.build_index(docs).terms) == 2
    assert hits() == want and len(want) > 100


def test_retrievals_search_bm25_once_and_fuse_what_they_found(spark, monkeypatch):
    from helmsman.plans import q_kb
    from helmsman.sources import fixtures as fx

    docs = [(i, f"w{i % 7} w{i % 3} common {'rare' if i % 9 == 0 else ''}") for i in range(60)] + [(100, "   "), (101, None), (102, ""), (103, "\t ")]
    rows = spark.createDataFrame([(i, t, "en", "a") for i, t in docs], "doc_id long, text string, lang string, source string")
    vecs = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 11), 1.0]) for i, _ in docs], "vec_id long, embedding array<float>")
    monkeypatch.setattr(fx, "table", lambda spark, sf_dir, name: {"documents": rows, "embeddings": vecs}[name])
    asked, search = [], bm25.search
    monkeypatch.setattr(bm25, "search", lambda *a, **k: asked.append(1) or search(*a, **k))
    qs, b, v, h = q_kb._retrievals(spark, "")
    assert len(asked) == 1
    kb = fx.knowledge_base(spark, "")
    index = bm25.build_index(kb.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
    want = fusion.search(index, kb, qs, HybridParams(fusion="weighted"), top_k=5, with_documents=False)
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, want.collect())) and h.count() >= 300
    assert {r["query_id"] for r in h.collect()} & {100, 101, 102} == set() and v.where("query_id = 100").count() == 10


def test_texts_are_split_and_lowercased_once(spark):
    texts = ["Great thanks, but the ERROR is bad bad", "", None, "refund my LAWYER payment", "good", "nothing here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")
    out = df.select("query_id", decision.sentiment("text").alias("s"), decision.sensitive_topics("text").alias("t"), decision.is_urgent("text").alias("u"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(") == 3
    for r, text in zip(out.orderBy("query_id").collect(), texts):
        words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
        pos, neg = (sum(w in x for w in words) for x in (decision.POSITIVE_WORDS, decision.NEGATIVE_WORDS))
        assert r["s"]["label"] == ("positive" if pos > neg else "negative" if neg > pos else "neutral")
        assert r["s"]["score"] == (0.5 + 0.5 * abs(pos - neg) / (pos + neg) if pos + neg else 0.5)
        p, low = DecisionParams(), (text or "").lower()
        topics = [name for name, kws in p.topics if any(k in low for k in kws)]
        n = sum(k in low for _, kws in p.topics for k in kws)
        assert (r["t"]["has_sensitive"], r["t"]["topics"], r["t"]["confidence"]) == (bool(topics), topics, min(1.0, n / 5.0))
        assert r["u"] == any(k in low for k in p.urgent_keywords)


def test_question_terms_are_counted_where_their_text_is(spark):
    rows = [(1, "alpha beta alpha"), (1, "beta"), (2, None), (3, ""), (None, "beta gamma"), (None, "beta")]
    qt = bm25.query_terms(spark.createDataFrame(rows, "query_id long, text string"))
    assert {(r["query_id"], r["term"]): r["qtf"] for r in qt.collect()} == {
        (1, "alpha"): 2, (1, "beta"): 2, (None, "beta"): 2, (None, "gamma"): 1}
    plan = qt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # of the texts, not of their terms
