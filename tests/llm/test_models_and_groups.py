"""Near-dedup, mixing, sharding, classifiers, LM scoring and the pipeline
against brute force or held-out accuracy, with the edge cases of each."""

import math
import pathlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helmsman.llm import decontaminate, extendible, lm_score, mixing, neardup, quality, toxicity
from helmsman.llm.labelled import fold, labelled
from helmsman.llm.shared import CLEANUP, documents, text_buffer, written
from helmsman.session import checkpoint_root
from tests.conftest import SF_MID, SF_SMALL

DOCS = "doc_id long, text string, source string, lang string, n string, node string, label string, a string, b string, size string"


def docs(spark, rows):
    rows = [(*r, "s")[:3] for r in rows]
    return spark.createDataFrame([(i, t, s, "en", "n", "o", "l", "a", "b", "z") for i, t, s in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, "null only"), (None, "null only"), (6, "x " * 30_000), (7, "two words"), (8, "words two")]


# --- near duplicates ---------------------------------------------------------

def _brute_groups(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i: i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * len(sets[i] | sets[j]):
                above[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in least[root(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def test_all_documents_equal_all_pairs(spark):
    for sf, width in ((SF_MID, 2),):
        rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
        got = neardup.near_duplicates(documents(spark, sf), shingle=width).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute_groups(rows, width)


def test_a_node_of_many_pairs_is_spread(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPREAD", 3)
    monkeypatch.setattr(neardup, "TILE_SHINGLES", 200)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w for w in words if rnd.random() > 0.03)) for i in range(120)] + [(200 + i, f"other {i} text") for i in range(5)]
    got = neardup.near_duplicates(docs(spark, rows), shingle=1).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_groups(rows, 1)


def test_the_labelled_sample_is_bounded_after_the_join(spark):
    texts = spark.createDataFrame([(7, "same")] * 50_000 + [(i, f"text {i}") for i in range(100, 400)] + [(500, "x" * 100_000), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (500, 0), (None, 1), *((i, i % 2) for i in range(100, 400))], "doc_id long, quality int")
    got = labelled(texts, labels, "quality", F.lit(True), limit=10).collect()
    assert len(got) == 10
    got = labelled(texts, labels, "quality", F.lit(True), limit=1000).collect()
    assert len(got) == 1000 and {r.label for r in got if r.doc_id == 7} <= {1}
    got = labelled(texts, labels, "quality", F.lit(True), limit=100_000, max_bytes=50).collect()
    assert 0 < sum(len(r.text) for r in got[:-1]) and sum(len(r.text) for r in got) < 50 + 100_000
    two = labelled(texts, spark.createDataFrame([(100, 0), (100, 1)], "doc_id long, quality int"), "quality", F.lit(True)).collect()
    assert sorted(r.label for r in two) == [0, 1]



def _families(seed, width, big):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "and", "in"] * 6 + [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows, passage = [], text(60)
    for size, words in ((big, 140), (12, 60), (5, 400), (6, 12), (4, 5), (30, 4)):
        base = text(words)
        for _ in range(size):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice((0, .02, .05, .12)) else w for w in base]
            rows.append(" ".join(copy).upper() if rng.random() < .1 else "  ".join(copy))
    rows += [" ".join(passage + text(rng.randrange(5, 80))) for _ in range(60)] + [" ".join(text(rng.randrange(40))) for _ in range(60)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + EDGE


@pytest.mark.parametrize("width,big,tile", [(2, 90, 512), (2, 90, 16), (5, 70, 16)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, width, big, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "HOT", 16)
    rows = _families(width, width, big)
    got = neardup.near_duplicates(docs(spark, rows).repartition(3), shingle=width).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_groups(rows, width)


def test_near_duplicates_keep_no_sketches_sets_or_shuffles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "PASS_BYTES", 1)
    budgets, tiles = [], neardup._tiles
    monkeypatch.setattr(neardup, "_tiles", lambda *a: budgets.append(tiles(*a)) or budgets[-1])
    root = pathlib.Path(checkpoint_root(spark).removeprefix("file:"))
    before, blocks = set(root.rglob("neardup-*")), _shuffle_blocks(spark)
    rows = _families(2, 2, 90)
    out = neardup.near_duplicates(docs(spark, rows).repartition(3), shingle=2)
    assert len(budgets[0]) > 1  # tiles go in several passes
    left = [spark.read.parquet(str(p)).columns for p in set(root.rglob("neardup-*")) - before]
    assert left and not any({"sketch", "grams", "v"} & set(columns) for columns in left)
    for _ in range(50):  # they go in the background
        if _shuffle_blocks(spark) <= blocks + 8:
            break
        time.sleep(0.2)
    assert _shuffle_blocks(spark) <= blocks + 8  # of the few counts that are no written table
    assert sorted((tuple(r) for r in out.collect()), key=str) == _brute_groups(rows, 2)


def _shuffle_blocks(spark) -> int:
    return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))


@pytest.mark.parametrize("set_to", [None, "false"])
def test_a_written_table_leaves_the_session_as_it_was(spark, set_to):
    spark.conf.unset(CLEANUP) if set_to is None else spark.conf.set(CLEANUP, set_to)
    before = spark.conf.get(CLEANUP, None)
    assert sorted(r.id for r in written(spark.range(5).distinct(), "left").collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get(CLEANUP, None) == before
    spark.conf.unset(CLEANUP)


def test_near_duplicates_empty_tables(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = dict(neardup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_tile_products_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 5000, rng.integers(1, 900))) for _ in range(30)]
    got = neardup.shared_counts(sets[:10], sets[10:], columns=128)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]


# --- mixing ------------------------------------------------------------------

def _brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, closed = 1.5 * sum(sizes.values()), set()
    while True:
        still = [s for s in names if s not in closed]
        share = (total - sum(2 * sizes[s] for s in closed)) / max(1, sum(weight[s] for s in still))
        new = {s for s in still if share * weight[s] > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in closed else share * weight[s] for s in names}
        closed |= new


def test_mixing_targets_and_nearness(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 20), rng.choice(["b", "a", "é", "~", "=", None, "Z"] + ["hot"] * 4)) for i in range(1500)]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "x\x00y  z", "a"), (None, "null id here", "a"), (None, "null id here", "a"), (3, "again", "b"), (3, "again", "b")]
    plan, cut = mixing.plan(docs(spark, rows))
    got = plan.join(cut, "_mx_source").select("doc_id", "size", "source_size", "target", (F.col("size") * mixing._copies()).alias("taken"), "_mx_source").collect()
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    targets = _brute_targets(sizes)
    taken = Counter()
    for r in got:
        s = r._mx_source[1:] if r._mx_source != "~" else None
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(1, largest[s]), s
    assert abs(taken["hot"] - targets["hot"]) < 0.01 * targets["hot"]
    again = mixing.mix(docs(spark, rows).repartition(5))
    assert again.columns == docs(spark, []).columns
    assert again.count() == sum(r.taken // r.size if r.size else 0 for r in got) + sum(1 for r in again.where("text is null or text = ''").collect())


def test_mixing_empty(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).collect() == []


def test_pareto_odds_favour_longer_documents(spark):
    rows = [(i, "w " * (4 if i % 2 else 400), "s") for i in range(4000)]
    plan, _ = mixing.plan(docs(spark, rows))
    keys = plan.groupBy("size").agg(F.avg("_mx_key").alias("k")).collect()
    assert {r["size"]: r.k for r in keys}[400] < {r["size"]: r.k for r in keys}[4]


# --- sharding ----------------------------------------------------------------

@pytest.mark.parametrize("step", [20, 3])
def test_shards_fit_and_split_only_when_needed(spark, monkeypatch, step):
    monkeypatch.setattr(extendible, "DIRECTORY_BITS", step)
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(300)) for i in range(700)] + [(5, "long" * 1000), (9000, None), (None, "n" * 40), (9001, "")]
    rows += [(7777, f"{i:>200}") for i in range(60)] + [(7778, "same" * 50)] * 40
    out = extendible.report(extendible.assign(docs(spark, rows).repartition(4), limit=2000), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    shards = defaultdict(list)
    for r in out:
        assert r.n_bytes == len((r.text or "").encode()) and r.depth == len(r.shard)
        shards[r.shard].append(r)
    for name, members in shards.items():
        assert all((r.shard_bytes, r.shard_docs) == (sum(m.n_bytes for m in members), len(members)) for r in members)
        assert members[0].shard_bytes <= 2000 or len(members) == 1
        assert not any(name != other and other.startswith(name) for other in shards)
        above = [r for r in out if name and r.shard.startswith(name[:-1])]
        assert not name or (sum(r.n_bytes for r in above) > 2000 and len(above) > 1)


def test_sharding_empty(spark):
    assert extendible.report(extendible.assign(docs(spark, [])), "doc_id").collect() == []


# --- classifiers -------------------------------------------------------------

def _auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Scum,", "vile", "IDIOT!"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad), "x"))
    labels = spark.createDataFrame(marks + [(5000, 1, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs(spark, rows), labels, "toxic", fold("doc_id", 3) != 1)
    assert len(model[0]) < 2000  # sparse
    got = {r.doc_id: r._toxicity for r in toxicity.score(docs(spark, rows), model).collect()}
    held = [(y, got[i]) for i, y, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert _auc(held) > 0.98 and np.mean([(s >= toxicity.THRESHOLD) == bool(y) for y, s in held]) > 0.95
    edge = toxicity.score(docs(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r._toxicity <= 1 for r in edge)
    assert len({r._toxicity for r in edge if not (r.text or "").strip()}) == 1


def test_models_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs(spark, EDGE), none, "toxic", F.lit(True))
    assert {r._toxicity for r in toxicity.score(docs(spark, EDGE), model).collect()} == {0.5}
    table = quality.train(docs(spark, EDGE), none, "quality", F.lit(True))
    assert {r._quality for r in quality.score(docs(spark, EDGE), table).collect()} == {0.5}
    assert quality.score(docs(spark, []), table).collect() == [] and toxicity.score(docs(spark, []), model).collect() == []


def _few_texts(seed, n=30):
    rng = random.Random(seed)
    return [(i, i % 2, " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(rng.randrange(0, 25))) + (" bad word" if i % 2 else "")) for i in range(n)]


def test_ftrl_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    bits, examples = 12, []
    for i, y, t in _few_texts(1):
        examples.append((i, y, np.unique(toxicity.features(*text_buffer(pa.array([t])), bits)[1])))
    slots, weights, bias = toxicity.fit(examples, bits)
    z, n, rng = defaultdict(float), defaultdict(float), np.random.default_rng(7)

    def weight(c):
        l1 = 0.0 if c == "bias" else toxicity.L1
        if abs(z[c]) <= l1:
            return 0.0
        return -(z[c] - math.copysign(l1, z[c])) / ((toxicity.BETA + math.sqrt(n[c])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at in rng.permutation(len(examples)):
            _, y, found = examples[at]
            active = [*found.tolist(), "bias"]
            w = {c: weight(c) for c in active}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for c in active:
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / toxicity.ALPHA * w[c]
                n[c] += g * g
    want = {c: weight(c) for c in z if c != "bias" and weight(c)}
    assert set(slots.tolist()) == set(want) and len(want) > 5
    assert all(abs(want[c] - w) < 1e-9 for c, w in zip(slots.tolist(), weights.tolist())) and abs(weight("bias") - bias) < 1e-9


def test_toxicity_scores_equal_naive_feature_lists(spark):
    rows = [(i, t) for i, _, t in _few_texts(2)] + [(900, None), (901, ""), (902, "Bad, WORD! bad word")]
    slots = [toxicity.features(*text_buffer(pa.array([t], pa.string())))[1] for _, t in rows]
    every = np.unique(np.concatenate(slots))
    model = (every[::2].astype(np.int32), np.linspace(-1, 1, len(every[::2])), 0.25)
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    got = {r.doc_id: r._toxicity for r in toxicity.score(docs(spark, rows), model).collect()}
    for (i, _), s in zip(rows, slots):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-0.25 - sum(weight.get(x, 0.0) for x in set(s.tolist())))))


def test_softmax_descent_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 3)
    examples = []
    for i, y, t in _few_texts(3, 20):
        found, count = np.unique(np.concatenate([s for _, s in quality.features([t])]), return_counts=True)
        examples.append((i, y, found.astype(np.int32), count.astype(np.int32)))
    table, d = quality.fit(examples), quality.DIMENSIONS
    rng = np.random.default_rng(11)
    start = (rng.random((2 << quality.BITS, d), np.float32) - 0.5) * (2 / d)
    touched = sorted({int(s) for e in examples for s in e[2]})
    v, out = {s: [float(x) for x in start[s]] for s in touched}, [[0.0] * d, [0.0] * d]
    done, steps = 0, quality.EPOCHS * len(examples)
    for _ in range(quality.EPOCHS):
        for at in rng.permutation(len(examples)):
            _, y, found, count = examples[at]
            share = {int(s): c / count.sum() for s, c in zip(found, count)}
            hidden = [sum(share[s] * v[s][j] for s in share) for j in range(d)]
            logits = [sum(a * b for a, b in zip(o, hidden)) for o in out]
            e = [math.exp(x - max(logits)) for x in logits]
            g = [(x / sum(e) - (k == y)) * quality.RATE * (1 - done / steps) for k, x in enumerate(e)]
            back = [g[0] * out[0][j] + g[1] * out[1][j] for j in range(d)]
            for k in (0, 1):
                out[k] = [o - g[k] * h for o, h in zip(out[k], hidden)]
            for s in share:
                v[s] = [x - min(share[s] * len(share), 1.0) * b for x, b in zip(v[s], back)]
            done += 1
    for s in touched:
        assert table[s] == pytest.approx(sum(x * (b - a) for x, a, b in zip(v[s], out[0], out[1])), abs=2e-4)


def test_quality_held_out_on_fixture(spark):
    sf = "/root/testdata/sf0.01"
    from helmsman.llm.queries import QUERIES

    marks = {r.doc_id: r.quality for r in spark.read.parquet(sf + "/labels.parquet").collect()}
    got = QUERIES["op8_subword_quality"](spark, sf).collect()
    held = [(marks[r.doc_id], r.score) for r in got if r.held_out and marks.get(r.doc_id) is not None]
    assert _auc(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_quality_broadcast_table_is_the_softmax_of_the_average():
    rng = np.random.default_rng(3)
    examples = [(i, i % 2, np.unique(rng.integers(0, 2 << quality.BITS, 50)).astype(np.int32), None) for i in range(20)]
    examples = [(i, y, s, np.ones(len(s), np.int32)) for i, y, s, _ in examples]
    table = quality.fit(examples)
    right = sum((table[s].mean() > 0) == bool(y) for _, y, s, _ in examples)
    assert table.shape == (2 << quality.BITS,) and right == len(examples)


def test_features_of_texts_are_alike_alone_and_together():
    texts = ["", "a b b", "Éé word \U0001F600x", " ", "b b a"]
    rows = defaultdict(Counter)
    for row, slot in quality.features(texts):
        for r, s in zip(row.tolist(), slot.tolist()):
            rows[r][s] += 1
    for i, t in enumerate(texts):
        alone = Counter()
        for _, slot in quality.features([t]):
            alone.update(slot.tolist())
        assert rows[i] == alone
    assert rows[1][quality.REPEAT] == 1 and rows[0] == Counter([quality.END])


def test_labelled_sample_is_bounded(spark):
    marks = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    rows = docs(spark, [(i, "t") for i in range(60)])
    assert labelled(rows, marks, "toxic", F.lit(True), 10).count() == 10
    assert labelled(rows, marks, "toxic", F.col("doc_id") < 5).count() == 5


# --- LM scoring --------------------------------------------------------------

def lm_brute_force(rows, good):
    """Sorted (id, tokens, in target, target bits, background bits), from the
    words themselves."""
    split = [re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) for _, t in rows]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for (i, _), w in zip(rows, split):
        for m in (0, 1):
            if m == 1 or i in good:
                words[m].update(w)
                pairs[m].update(zip(w, w[1:]))
    want = []
    for (i, _), w in zip(rows, split):
        own_words, own_pairs, bits = Counter(w), Counter(zip(w, w[1:])), []
        for m in (0, 1):
            less = 1 if m == 1 or i in good else 0
            total = sum(words[m].values()) - less * len(w)
            loss = 0.0
            for k, x in enumerate(w):
                p = (1 - lm_score.FLOOR) * (words[m][x] - less * own_words[x]) / max(total, 1) + lm_score.FLOOR / len(words[1])
                v = w[k - 1] if k else None
                before = words[m][v] - less * own_words[v] if k else 0
                if before > 0:
                    p = lm_score.MIX * min(1, (pairs[m][v, x] - less * own_pairs[v, x]) / before) + (1 - lm_score.MIX) * p
                loss -= math.log2(p)
            bits.append(loss / max(1, len(w)))
        want.append((i, len(w), i in good, *[round(b, 9) for b in bits]))
    return sorted(want, key=str)


def lm_scores(flagged, **sizes):
    got = lm_score.score(flagged, **sizes).collect()
    return sorted(((r.doc_id, r._lm_tokens, r._lm_target, round(r._lm_target_bits, 9), round(r._lm_background_bits, 9)) for r in got), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "range_bytes": 64}])  # one block a task, or many blocks and ranges
def test_lm_scores_match_brute_force(spark, sizes):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "of", "Cat", "dog,", "é", "runs"]) for _ in range(rng.randrange(25)))) for i in range(40)]
    rows += [(1, "repeated id"), (None, "the cat"), (50, None), (51, "--"), (52, "the " * 3000)]
    marks = [(i, 1) for i in range(0, 40, 3)] + [(1, 0), (4, 0), (4, 1), (None, 1), (6, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    flagged = lm_score.flagged(docs(spark, rows).repartition(3), labels)
    good = {i for i, q in marks if q == 1 and i is not None}
    assert lm_scores(flagged, **sizes) == lm_brute_force(rows, good)


def test_lm_scores_of_the_fixture_match_brute_force(spark):
    source = documents(spark, SF_SMALL).select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert lm_scores(lm_score.flagged(source, labels)) == lm_brute_force([tuple(r) for r in source.collect()], good)


def test_lm_blocks_and_ranges():
    """Every document in one block, and the entries of the blocks add up."""
    words = [f"w{i % 7} x{i}" for i in range(300)]
    keys, target, background = lm_score._counted(*text_buffer(pa.array(words)), np.arange(300) % 2 == 0)
    assert len(keys) == 7 + 300 + 300 and background.sum() == 900 and target.sum() == 450
    assert all(map(np.array_equal, lm_score.unpack(lm_score.pack(target, background), len(keys), 2), (target, background)))
    for bits in (0, 3, 12):
        of, first = lm_score._ranges(keys, bits)
        assert (np.diff(of) > 0).all() and first[0] == 0 and of[-1] < 1 << bits


def test_lm_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    flagged = lm_score.flagged(docs(spark, []), labels)
    assert lm_score.score(flagged).collect() == []
    flagged = lm_score.flagged(docs(spark, EDGE), labels)
    assert all(r._lm_target_bits >= 0 for r in lm_score.score(flagged).collect())
    extra = lm_score.flagged(docs(spark, EDGE).withColumns({"score": F.lit("s"), "block": F.lit(None).cast("int"), "words": F.array(F.lit(1))}), labels)
    assert {(r.score, r.block, tuple(r.words)) for r in lm_score.score(extra).collect()} == {("s", None, (1,))}


# --- pipeline ----------------------------------------------------------------

def test_pipeline_stages_on_the_fixture(spark):
    source = documents(spark, SF_SMALL)
    seen, stage_docs = {}, source
    for name, stage in corpus_pipeline.STAGES:
        stage_docs = stage(spark, stage_docs, SF_SMALL)
        stage_docs = corpus_pipeline.written(stage_docs, "test")
        seen[name] = stage_docs
        if name != "sharding":
            assert stage_docs.columns == source.columns
    text = {r.doc_id: r.text for r in source.collect()}
    good = [r.doc_id for r in seen["quality classifier"].collect()]
    score = {r.doc_id: r._quality for r in quality.score(source, quality.quality_model(spark, source, SF_SMALL)).collect()}
    assert sorted(good) == sorted(i for i, s in score.items() if s >= 0.3)
    groups = _brute_groups([(i, text[i]) for i in good], 5)
    once = sorted(r.doc_id for r in seen["near-duplicate removal"].collect())
    assert once == sorted(i for i, _, _, kept in groups if kept)
    bench = spark.read.parquet(SF_SMALL + "/benchmark.parquet")
    patterns = decontaminate.windows([(str(r.item_id), r.text) for r in bench.collect()])

    def dirty(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return any(p in decontaminate.canonical(raw, np.array([0, len(raw)]))[0].tobytes() for p in patterns)

    clean = sorted(r.doc_id for r in seen["benchmark decontamination"].collect())
    assert clean == [i for i in once if not dirty(text[i])]
    mixed = Counter(r.doc_id for r in seen["mixing to target weights"].collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    sharded = seen["sharding"].collect()
    assert Counter(r.doc_id for r in sharded) == mixed
    assert all(r.shard_bytes <= extendible.SHARD_BYTES or r.shard_docs == 1 for r in sharded)
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(sharded)


def test_pipeline_keeps_one_of_repeated_rows(spark):
    rows = docs(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "z")])
    got = corpus_pipeline.one_of_each_group(spark, rows, SF_SMALL).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c d e f g"), (3, None), (None, "z")], key=str)


def test_text_buffers_survive_slicing():
    raw, off = np.frombuffer(b"a b", np.uint8), np.array([0, 1, 1, 3])
    assert [len(s) for s in neardup.shingle_sets(raw, off, 2)] == [1, 0, 1]
    assert pa.array([1]).to_pylist() == [1]
