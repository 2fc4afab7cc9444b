"""Product quantisation, the segmented keyword index, public subwords, JSON
containment, result reuse and live rates against brute force or public encoders."""

import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helmsman.functions import vectors as V
from helmsman.operators import bm25, byte_pairs, context, embedder, knn, names, pq, segments, sentiment
from helmsman.sources import fixtures as fx
from helmsman.streaming import jobs
from tests.conftest import SF_SMALL

# --- product quantisation ----------------------------------------------------


def _vectors(spark, m, name="id", column="embedding"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, {column} array<float>")


def _clustered(n=3000, dim=30, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, dim))


def test_quantised_search_has_recall_and_exact_scores(spark):
    x = _clustered()
    kb, qs = _vectors(spark, x), _vectors(spark, x[:200] + 0.05, "query_id", "vector")
    quantiser = pq.train(kb, 10)
    assert quantiser.probes < len(quantiser.coarse)  # clustered vectors need few lists
    codes = pq.encode(kb, quantiser)
    assert codes.count() == len(x) and codes.select(F.max(F.length("code"))).first()[0] == -(-30 // pq.GROUP)
    got, exact = pq.search(kb, codes, quantiser, qs, 10).collect(), knn.search(kb, qs, 10)
    truth = {(r["query_id"], r["doc_id"]): r["score"] for r in exact.collect()}
    assert sum((r["query_id"], r["doc_id"]) in truth for r in got) >= 0.95 * len(truth)
    assert all(abs(truth[r["query_id"], r["doc_id"]] - r["score"]) < 2e-6 for r in got if (r["query_id"], r["doc_id"]) in truth)
    assert {r["rank"] for r in got} == set(range(1, 11))


def test_quantised_recall_on_the_fixture_vectors(spark):
    kb = fx.knowledge_base(spark, SF_SMALL).select("id", "embedding")
    qs = fx.vector_questions(spark, SF_SMALL)
    quantiser = pq.train(kb, 10)
    got = pq.search(kb, pq.encode(kb, quantiser), quantiser, qs, 10)
    assert knn.recall_at_k(got, knn.search(kb, qs, 10)).first()[0] >= 0.9


def test_query_blocks_do_not_change_the_hits(spark):
    from helmsman.config import VectorParams

    x = _clustered(400)
    kb, qs = _vectors(spark, x), _vectors(spark, x[:50], "query_id", "vector")
    quantiser = pq.train(kb, 5)
    codes = pq.encode(kb, quantiser)
    one, many = (sorted(map(tuple, pq.search(kb, codes, quantiser, qs, 5, p).collect())) for p in (None, VectorParams(broadcast_max_bytes=4_000)))
    assert one == many and len(one) == 250


def test_quantiser_edge_cases(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, 2.0]), (5, [1.0, 0.0, 0.0]), (6, [float("nan"), 0.0, 1.0])]
    kb = spark.createDataFrame(rows, "id long, embedding array<float>")
    qs = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, vector array<float>")
    quantiser = pq.train(kb, 3)
    codes = pq.encode(kb, quantiser)
    assert sorted(r["id"] for r in codes.collect()) == [1, 5]
    assert [tuple(r) for r in pq.search(kb, codes, quantiser, qs, 3).orderBy("rank").collect()] == [(1, 1, 1.0, 1), (1, 5, 1.0, 2)]
    assert pq.search(kb, codes, quantiser, qs.limit(0), 3).count() == 0
    nothing = kb.limit(0)
    assert pq.search(nothing, pq.encode(nothing, pq.train(nothing, 3, dim=3)), pq.train(nothing, 3, dim=3), qs, 3).count() == 0


def test_decoded_codes_are_the_lookup_sums():
    unit, _ = pq.unit_rows(pa.array([list(map(float, v)) for v in _clustered(500, 12)]), 12)
    made = pq.fit(unit, 8)
    lists = made.assign(unit)
    codes = made.code(unit, lists)
    q = unit[3]
    tables = [book @ q[a:b] for (a, b), book in zip(made.cuts, made.books)]
    sums = made.coarse[lists] @ q + sum(t[codes[:, g]] for g, t in enumerate(tables))
    assert np.allclose(sums, made.decode(codes, lists) @ q, atol=1e-5)


# --- segmented index ---------------------------------------------------------

WORDS = "red green blue cyan pink gray gold teal lime navy plum rust".split()


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _state(index):
    built = index if isinstance(index, bm25.Bm25Index) else index.index()
    return (built.n_docs, round(built.avgdl, 9), round(built.avg_idf, 9), sorted((r["term"], r["df"], round(r["idf"], 9)) for r in built.terms.collect()),
            sorted((r["doc_id"], r["term"], r["tf"], round(r["w"], 9)) for r in built.postings.collect()))


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_twenty_changes_equal_a_rebuild(spark, scratch, few_partitions):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 9)))
    now = {i: text() for i in range(60)}
    index = segments.create(_texts(spark, list(now.items())), f"{scratch}/index")
    for step in range(20):
        if step % 3 == 2:
            gone = rnd.sample(sorted(now), 4)
            index.remove(_texts(spark, [(i, "") for i in gone + [9999]]), key=f"r{step}")
            now = {i: t for i, t in now.items() if i not in gone}
        else:
            new = {rnd.randrange(80): text() for _ in range(5)}
            index.upsert(_texts(spark, list(new.items())), key=f"u{step}")
            now |= new
    assert index.base == 0 and len(index.live) == 21  # nothing was rewritten
    rebuilt = bm25.build_index(_texts(spark, list(now.items())))
    assert _state(index) == _state(rebuilt)
    assert _state(segments.open_index(spark, f"{scratch}/index")) == _state(rebuilt)
    qs = spark.createDataFrame([(i, text()) for i in range(30)], "query_id long, text string")
    hits = lambda built: sorted(map(tuple, bm25.search(built, qs, k=5).collect()))
    assert hits(index.index()) == hits(rebuilt)
    before = _state(index)
    assert _state(index.compact()) == before and len(index.live) == 1
    index.upsert(_texts(spark, [(3, "red red")]), key="u0")  # a key that was applied already
    assert _state(index) == before


def test_a_change_shuffles_nothing_of_the_base(spark, scratch):
    index = segments.create(_texts(spark, [(i, f"red w{i}") for i in range(3000)]), f"{scratch}/index")
    ids = _texts(spark, [(i, "") for i in range(2, 2990)]).select("doc_id")
    plan = index.hidden_rows(ids, 2988)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange range" not in plan
    few = index.hidden_rows(ids.limit(3), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in few and "PushedFilters: [In(doc_id" in few


def test_segments_are_merged_when_due(spark, scratch, monkeypatch):
    monkeypatch.setattr(segments, "MAX_SEGMENTS", 3)
    index = segments.create(_texts(spark, [(1, "red"), (2, "blue blue")]), f"{scratch}/index")
    for i in range(5):
        index.upsert(_texts(spark, [(1, f"red w{i}")]))
    assert len(index.live) <= 3 and _state(index) == _state(bm25.build_index(_texts(spark, [(1, "red w4"), (2, "blue blue")])))


def test_segment_edge_cases(spark, scratch):
    index = segments.create(_texts(spark, []), f"{scratch}/index")
    assert index.n_docs == 0 and index.rows().count() == 0
    index.upsert(_texts(spark, [(1, None), (2, ""), (None, "red"), (3, "red"), (3, "blue")]))
    assert _state(index) == _state(bm25.build_index(_texts(spark, [(1, None), (2, ""), (3, "blue")])))
    index.upsert(_texts(spark, [(7, "new"), (3, "pink")]), known_only=True)
    assert {r["doc_id"] for r in index.rows().collect()} == {1, 2, 3}
    index.remove(_texts(spark, [(1, ""), (2, ""), (3, "")]))
    assert index.n_docs == 0 and index.terms().count() == 0
    qs = spark.createDataFrame([(1, "pink")], "query_id long, text string")
    assert bm25.search(index.index(), qs).count() == 0
    index.upsert(_texts(spark, [(3, "pink")]))
    assert _state(index) == _state(bm25.build_index(_texts(spark, [(3, "pink")])))


# --- subwords ----------------------------------------------------------------

def test_subwords_equal_a_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = byte_pairs.load()
    ranks = vocabulary.ranks
    pattern = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = [(r["doc_id"], r["text"]) for r in fx.table(spark, SF_SMALL, "documents").collect()]
    docs += [(10_001, None), (10_002, ""), (10_003, "  two  spaces \n\n"), (10_004, "naïve 東京 🙂 it's"), (10_005, "z" * 3000), (10_006, "\x00́x")]
    got = byte_pairs.encode(_texts(spark, docs), vocabulary, "doc_id", max_length=512)
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in docs:
        want = public.encode_ordinary(t or "")
        assert rows[i]["input_ids"] == want[:512] and rows[i]["n_tokens"] == len(want), i
        assert rows[i]["attention_mask"] == [1] * min(len(want), 512)
    whole = byte_pairs.encode(_texts(spark, docs), vocabulary, "doc_id", max_length=1 << 30)
    assert {r["doc_id"]: r["text"] or "" for r in byte_pairs.decode(whole, vocabulary, "doc_id").collect()} == {i: t or "" for i, t in docs}


def test_long_words_merge_as_short_ones():
    ranks, rnd = byte_pairs.load().ranks, random.Random(1)
    for _ in range(200):
        word = bytes(rnd.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rnd.randrange(1, 80)))
        assert byte_pairs.merged_long(word, ranks) == byte_pairs.merged(word, ranks) or word in ranks


def test_salted_words_equal_broadcast_words(spark, monkeypatch):
    docs = _texts(spark, [(i, f"the the cat{i % 7} the") for i in range(50)])
    vocabulary = byte_pairs.load()
    one = sorted(map(str, byte_pairs.encode(docs, vocabulary, "doc_id").collect()))
    monkeypatch.setattr(byte_pairs, "BROADCAST_WORDS", 0)
    assert sorted(map(str, byte_pairs.encode(docs, vocabulary, "doc_id").collect())) == one


# --- JSON containment --------------------------------------------------------

CONTAINS = [
    ('"foo"', "foo", True), ("[1, 2, 3]", [1, 3], True), ("[1, 2, 3]", [3, 1, 3], True), ("[1, 2, 3]", 2, True), ('["foo", "bar"]', "bar", True), ('"bar"', ["bar"], False),
    ('{"product": "X", "version": 9.4, "jsonb": true}', {"version": 9.4}, True), ("[1, 2, [1, 3]]", [1, 3], False), ("[1, 2, [1, 3]]", [[1, 3]], True),
    ('{"foo": {"bar": "baz"}}', {"bar": "baz"}, False), ('{"foo": {"bar": "baz"}}', {"foo": {}}, True), ('{"a": 1}', {"a": "1"}, False), ('{"a": 1.0}', {"a": 1}, True),
    ('{"a": null}', {"a": None}, True), ("{}", {"a": None}, False), ('{"a.b": 1}', {"a.b": 1}, True), ('{"a": {"b": 1}}', {"a.b": 1}, False), ("[]", [], True), ("{}", [], False),
    ('{"a": [1, {"b": [true, "x"]}]}', {"a": [{"b": ["x"]}]}, True), ('{"a": true}', {"a": 1}, False), ('{"it\'s": 2}', {"it's": 2}, True), (None, {}, False),
    ('{"n": 9007199254740993}', {"n": 9007199254740992}, False), ("true", True, True), ("1", True, False),
]


def test_json_containment(spark):
    for value, want, expected in CONTAINS:
        row = spark.createDataFrame([(value,)], "j string").select(V.json_contains(F.parse_json("j"), want).alias("c")).first()
        assert row["c"] is expected, (value, json.dumps(want))


# --- reuse and rates ---------------------------------------------------------

def test_reuse_takes_the_latest_valid_answer(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    log = [(1, "a", at(1)), (2, "a", at(2)), (3, "a", at(2)), (4, "b", at(1)), (5, "a", at(9))]
    asked = [(10, "a", at(2)), (11, "a", at(2, 30)), (12, "a", at(4)), (13, "b", at(2)), (14, "c", at(2)), (15, "a", at(1)), (16, "b", at(2, 1)), (17, None, at(2))]
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, qhash string, created_at timestamp")
    got = {r["query_id"]: (r["cached_id"], r["age_us"] and r["age_us"] // 60_000_000) for r in context.reuse_cached(frame(asked), frame(log), 3600).collect()}
    assert got == {10: (1, 60), 11: (2, 30), 12: (None, None), 13: (4, 60), 14: (None, None), 15: (None, None), 16: (None, None), 17: (None, None)}
    gone = spark.createDataFrame([(2,), (3,)], "query_id long")
    got = {r["query_id"]: r["cached_id"] for r in context.reuse_cached(frame(asked), frame(log), 2 * 3600, gone).collect()}
    assert got[11] == 1 and got[10] == 1 and got[16] == 4


def test_pane_sketches_are_close_in_rank(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=60_000)
    start = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(start + dt.timedelta(seconds=int(i % 300)), "auto", float(v)) for i, v in enumerate(values)], "created_at timestamp, routing_decision string, latency_ms double")
    one = [r for r in jobs.live_rates_by_panes(log).collect() if r["window_start"] == start]
    exact = [r for r in jobs.live_rates(log).collect() if r["window_start"] == start]
    assert one[0]["n"] == exact[0]["n"] == 60_000
    for q, c in ((0.5, "p50_latency_ms"), (0.95, "p95_latency_ms")):
        assert exact[0][c] == np.sort(values)[int(np.ceil(q * 60_000)) - 1]
        assert abs((values <= one[0][c]).mean() - q) < 0.005


# --- latent vectors, trained sentiment ---------------------------------------

def test_latent_vectors_equal_a_numpy_decomposition(spark):
    rnd = random.Random(6)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(5)]
    rows = [(i, " ".join(rnd.choices(topics[i % 5], k=15) + rnd.choices(WORDS, k=3))) for i in range(300)] + [(900, None), (901, "")]
    docs, features = _texts(spark, rows), 512
    model = embedder.fit_latent(docs.repartition(3), dim=5, features=features, rounds=6)
    slots = docs.select("doc_id", embedder._slots("text", features).alias("s")).toPandas()
    x = np.zeros((len(slots), features))
    for i, s in enumerate(slots["s"]):
        for j in s if s is not None else ():
            x[i, j] += 1
    x *= np.log((len(rows) + 1) / ((x > 0).sum(0) + 1))
    x /= np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    _, singular, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular, singular[:5], rtol=1e-3)
    assert np.linalg.norm(vt[:5] @ model.basis, 2) == pytest.approx(1, abs=1e-3) and np.linalg.norm(vt[:5] @ model.basis, "fro") ** 2 == pytest.approx(5, abs=0.01)
    again = embedder.fit_latent(docs.repartition(2), dim=5, features=features, rounds=6)
    assert np.allclose(model.basis, again.basis, atol=1e-6)  # seed-stable
    got = {r["doc_id"]: np.array(r["embedding"]) for r in embedder.embed_latent(model, docs).collect()}
    assert not got[900].any() and not got[901].any() and all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in range(300))
    m = np.array([got[i] for i in range(300)])
    best = np.argsort(-(m @ m.T), axis=1)[:, 1:6]
    assert (best % 5 == np.arange(300)[:, None] % 5).mean() > 0.95


def test_trained_sentiment_is_saved_and_loaded(spark, scratch):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(WORDS, k=8) + [("nice" if i % 2 else "awful")]), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows + [(900, None, None), (901, "", None)], "query_id long, text string, positive int")
    sentiment.save(sentiment.fit(df, slots=1 << 10), f"{scratch}/model")
    got = {r["query_id"]: r["sentiment"] for r in sentiment.classify(sentiment.load(f"{scratch}/model"), df).collect()}
    assert sum(got[i]["label"] == ("positive" if i % 2 else "negative") for i in range(200)) > 195
    assert got[900] == got[901] == ("neutral", 0.5)
    with pytest.raises(ValueError):
        sentiment.fit(df.where("positive = 1"))


# --- names -------------------------------------------------------------------

def test_names_are_learnt_from_contexts(spark):
    rnd = random.Random(12)
    people = ["Alice", "Boris", "Chloé", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ingrid", "Jean-Luc", "Keiko", "Luca"]
    places = ["Paris", "Oslo", "Monday", "Invoice", "Router", "Windows"]
    frames = ["Dear {} , thank you", "my name is {} and I", "regards , {} from support", "please ask {} about it", "spoke with {} yesterday"]
    other = ["flight to {} was late", "the {} is broken", "on {} we wait", "restart {} now please", "in {} it rains"]
    rows = [rnd.choice(frames).format(rnd.choice(people)) for _ in range(900)] + [rnd.choice(other).format(rnd.choice(places)) for _ in range(900)] + [None, "", "Alone"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r["name"]: r["round"] for r in names.learn(texts, ["Alice", "Boris", "Chloé", "Nobody"]).collect()}
    new = {n for n, step in found.items() if step > 0}
    assert new and new <= set(people) and len(new) >= 0.8 * (len(people) - 3)  # precision 1, recall 0.8 at least
    params = names.as_params(names.learn(texts, ["Alice", "Boris", "Chloé"]))
    from helmsman.functions import pii

    row = spark.createDataFrame([("please ask Keiko about Paris",)], "t string").select(pii.counts("t", params)["PERSON"].alias("n")).first()
    assert row["n"] == 1
    assert [r["name"] for r in names.learn(texts.limit(0), ["Alice"]).collect()] == ["Alice"]


# --- bounded memory, tables that are folders -----------------------------------

def test_a_tile_of_questions_leaves_before_the_next_begins(monkeypatch):
    monkeypatch.setattr(knn, "QUERY_TILE", 4)
    monkeypatch.setattr(knn, "CHUNK_BYTES", 8 * 3 * 10)  # ten documents
    rng = np.random.default_rng(1)
    d, q = rng.normal(size=(25, 3)), rng.normal(size=(9, 3))

    def batches():
        for at in range(0, 25, 5):
            assert at < 10 or seen  # the first ten documents are scored before more are read
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 5)), pa.array(d[at:at + 5].tolist())], names=["id", "embedding"])

    seen = []
    for part in knn._search_kernel(lambda: (np.arange(9), q, None), 2, 3)(batches()):
        assert len(set(part["query_id"].to_numpy() // 4)) == 1
        seen.append(part.num_rows)
    assert len(seen) == 3 * 3 and sum(seen) >= 9 * 2 * 3


def test_lsh_compares_exactly_the_pairs_of_a_common_bucket(spark):
    from helmsman.config import VectorParams

    x = _clustered(500, 6)
    kb, qs = _vectors(spark, x), _vectors(spark, x[:40] + 0.1, "query_id", "vector")
    p = VectorParams(lsh_bucket_length=0.2, lsh_tables=2)
    one, many = (sorted(map(tuple, knn.approx_search(kb, qs, 3, v).collect())) for v in (p, VectorParams(lsh_bucket_length=0.2, lsh_tables=2, broadcast_max_bytes=0, block_rows=7)))
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in knn.search(kb, qs, 500).collect()}
    assert one == many and 0 < len(one) <= 120
    assert all(exact[q, d] == pytest.approx(s, abs=2e-6) for q, d, s, _ in one)
    other = _vectors(spark, -x)  # each id three times, with two vectors
    assert [r[:2] for r in sorted(map(tuple, knn.approx_search(kb.union(kb), qs, 3, p).collect()))] == [r[:2] for r in one]
    assert knn.approx_search(kb.union(kb).union(other), qs, 3, p).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n")).where("n > 3").count() == 0


def test_quantised_search_by_small_chunks(monkeypatch):
    x = _clustered(2000).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    quantiser = pq.fit(unit, 8)
    lists = quantiser.assign(unit)
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(range(2000)), pa.array([c.tobytes() for c in quantiser.code(unit, lists)])], names=["list", "id", "code"])

    def best(chunk, tile):
        monkeypatch.setattr(pq, "CHUNK_CODES", chunk)
        monkeypatch.setattr(pq, "QUESTION_TILE", tile)
        found = {}
        for part in pq._scan_kernel(lambda: (quantiser, unit[:30]))([batch]):
            assert len(set(part["q"].to_numpy() // tile)) <= 1  # one tile's survivors at a time
            for q, d, s in zip(*(part[c].to_pylist() for c in ("q", "doc_id", "score"))):
                found.setdefault(q, []).append((-round(s, 5), d))
        return {q: sorted(v)[:10] for q, v in found.items()}

    assert best(300, 7) == best(1 << 17, 1024)


def test_no_row_per_word_is_shuffled(spark):
    docs = _texts(spark, [(i, f"the cat{i % 7} sat on, the") for i in range(50)] + [(60, None), (7, "once more")])
    vocabulary = byte_pairs.load()
    made = byte_pairs.encode(docs, vocabulary, "doc_id")
    assert "Generate" not in made._jdf.queryExecution().toString()
    assert "Generate" not in byte_pairs.decode(made, vocabulary, "doc_id")._jdf.queryExecution().toString()
    rows = {r["doc_id"]: r for r in made.collect()}
    assert len(rows) == 51 and rows[60]["input_ids"] == [] and rows[7]["n_tokens"] == rows[0]["n_tokens"] + 2


def test_subwords_meet_the_vocabulary_by_distinct_terms(spark):
    from helmsman.operators import subword

    docs = _texts(spark, [(i, "a a b " * 40 + f"c{i % 5}") for i in range(40)] + [(50, None), (51, ""), (52, "a zz")])
    vocab = subword.build_vocab(docs.where("doc_id <> 52"))
    ids = {r["term"]: r["id"] for r in vocab.table.collect()}
    got = {r["doc_id"]: r for r in subword.encode(docs, vocab, "doc_id", max_length=8).collect()}
    assert got[3]["input_ids"] == [2, *(ids[t] for t in "a a b a a b".split()), 3] and got[3]["n_tokens"] == 121
    assert got[50]["input_ids"] == got[51]["input_ids"] == [] and got[52]["input_ids"] == [2, ids["a"], 1, 3]
    assert "partial_collect_list" not in subword.encode(docs, vocab, "doc_id")._jdf.queryExecution().toString()


def test_terms_of_a_segment_are_counted_where_the_text_is(monkeypatch):
    monkeypatch.setattr(segments, "ROWS", 2)
    toks = [["a", "b", "a"], [], None, ["b"], ["c", "c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([3, 0, 0, 1, 3], pa.int32()), pa.array(toks, pa.list_(pa.string()))], names=["doc_id", "dl", "toks"])
    rows = [r for part in segments._count_terms([batch]) for r in part.to_pylist()]
    assert [(r["doc_id"], sorted((t["term"], t["tf"]) for t in r["terms"])) for r in rows] == [(0, [("a", 2), ("b", 1)]), (1, []), (2, []), (3, [("b", 1)]), (4, [("c", 3)])]


def test_language_gains_in_the_task_equal_joined_gains(spark, monkeypatch):
    from helmsman.config import LangParams
    from helmsman.operators import language

    monkeypatch.setattr(language, "CHARS", 50)
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "el gato está en la mesa", "es"), (4, "東京 über", "de"), (5, "", "en"), (6, None, "fr"), (1, "der hund", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small, joined = (language.train(df, params=LangParams(profile_max_bytes=b)) for b in (1 << 20, 0))
    assert "Generate" not in language.scores(df, small, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({r["doc_id"]: r for r in language.scores(df, p, "doc_id", "text").collect()} for p in (small, joined))
    assert a.keys() == b.keys()
    for i in a:
        assert all(a[i][c] == pytest.approx(b[i][c], abs=1e-9) for c in a[i].asDict() if c.startswith("score_"))


def test_a_table_of_several_files_is_one_micro_batch(spark, scratch):
    spark.range(30).repartition(3).write.parquet(f"{scratch}/pages.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{scratch}/one")
    schema = spark.read.parquet(f"{scratch}/one").schema
    seen = []
    rows = jobs.table_stream(spark, scratch, "pages", schema)
    rows.writeStream.foreachBatch(lambda b, e: seen.append(b.count())).option("checkpointLocation", f"{scratch}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [30]
