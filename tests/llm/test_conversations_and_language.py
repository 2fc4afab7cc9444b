"""Conversation repair, prefix trie and language ID against brute force, with the
edge cases of each."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helmsman.llm import conversation_repair as repair
from helmsman.llm import language_id, prefix_trie
from helmsman.llm.labelled import fold
from helmsman.llm.queries import QUERIES
from helmsman.llm.shared import documents, text_buffer
from tests.conftest import SF_MID

CONV = "conv_id long, turn long, role string, text string, pos string, code string, sequence string, side string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "s", "d") for r in rows], CONV)


# --- repair ------------------------------------------------------------------

def _cheapest(symbols):
    """(cost, least edits), by a forward search over all edits."""
    def grow(v):
        add = lambda x: (x[0] + 3, x[1] + "I")
        two = min(v[2], add(v[0]), add(v[1]), add(v[3]))
        return [v[0], v[1], two, min(v[3], add(two))]

    far = (10**6, "")
    now = grow([(0, ""), far, far, far])
    for s in symbols:
        new = [far] * 4
        for q, (cost, done) in enumerate(now):
            new[q] = min(new[q], (cost + 4, done + "D"))
            if s != 8:
                cut, to = (3 if s >= 4 else 0), 3 if q == 2 else 2
                new[to] = min(new[to], (cost + 3 + cut, done + "R"))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}.get(("sua?"[s % 4], q))
                if kept is not None:
                    new[kept] = min(new[kept], (cost + cut, done + "K"))
        now = grow(new)
    return min(now[0], now[3])


def test_block_tables_give_the_least_of_the_cheapest_edits():
    rnd = random.Random(5)
    cases = [s for n in range(4) for s in itertools.product(range(9), repeat=n)]
    cases += [[rnd.randrange(9) for _ in range(rnd.randrange(4, 23))] for _ in range(3000)]
    for s in cases:
        assert repair.edits(np.array(s, np.int64)) == _cheapest(s), s


def _brute_repair(rows):
    """The contract's rows from (conv, turn, role, text), with its damage."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t, " " if r is None else r, " " if x is None else x))
    out = []
    for c, group in groups.items():
        rows = []
        for t, r, x in group:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind == 0:
                continue
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            rows += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda z: (z[0] is not None, z[0] or 0, hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
        seen, faults, symbols = set(), Counter(), []
        for t, r, x in rows:
            body = x.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            faults[fault] += 1
            symbols.append(8 if fault in ("blank", "duplicate") else "sua".find(r[:1] or "?") % 4 + (4 if fault else 0))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = _cheapest(symbols)
        lines, at, q = [], 0, 0
        for e in audit:
            new = "assistant" if q == 2 else "user"
            if e == "I":
                lines.append(new + ":")
            else:
                _, r, x = rows[at]
                at += 1
                if e == "D":
                    continue
                lines.append((r if e == "K" else new) + ":" + x)
                if e == "K":
                    q = {"s": 1, "u": 2, "a": 3}[r[0]]
                    continue
            q = 3 if new == "assistant" else 2
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


_WORDS = ["Hi.", "Yes!", "so and", "", " ", None, "a?\t", "Hi.", "ünï.", "x" * 3000]


def test_repair_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = [(c, rnd.choice([None, *range(9)]) if c % 3 == 0 else t, rnd.choice(["system", "user", "assistant", "user", "assistant", "", None, "tool", "User"]), rnd.choice(_WORDS))
            for c in range(60) for t in range(rnd.randrange(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (-5, 2, "user", "ok.")] + [(1000, t, "user" if t % 2 else "system", "Go.") for t in range(-3, 40)]
    rows += [(77, 3, "user", "Same."), (77, 3, "user", "Same."), (77, 3, "assistant", "Other.")]
    got = repair.repair_report(repair.damage(conversations(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_repair(rows)


def test_repaired_rows_are_valid_conversations(spark):
    rows = [(c, t, random.Random(c * 31 + t).choice(["system", "user", "assistant"]), f"Turn {t}.") for c in range(30) for t in range(8)]
    got = repair.repaired(conversations(spark, rows)).where("pos > 0 and role is not null").orderBy("conv_id", "pos").collect()
    texts = defaultdict(str)
    for r in got:
        texts[r.conv_id] += r.role[0]
    assert len(texts) == 30 and all(re.fullmatch("s?(ua)+", t) for t in texts.values())


def test_repair_of_an_empty_table(spark):
    assert repair.repair_report(repair.damage(conversations(spark, []))).collect() == []


# --- prefix trie -------------------------------------------------------------

def _brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [z[3:] for z in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()), key=str)


def _trie(spark, rows, **how):
    found = prefix_trie.sequences(conversations(spark, rows))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(found), **how).select(*cols).collect()), key=str)


def _dialogues(seed, n=400):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "ccç"])) for c in range(n) for t in range(rnd.randrange(1, 7))]
    rows += [(5000 + c, t, "user", "hot" * t) for c in range(300) for t in range(3)]  # copies
    rows += [(9000, t, "user", f"long {t}") for t in range(300)] + [(-7, None, "user", "x"), (-7, 1, "user", "y"), (None, 1, "user", "z"), (-7, 1, "user", "y")]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard": 16, "fan": 2}, {"shard": 200, "fan": 3}])
def test_trie_equals_brute_force(spark, how):
    rows = _dialogues(11)
    assert _trie(spark, rows, **how) == _brute_trie(rows)


def test_trie_of_few_and_no_conversations(spark):
    assert _trie(spark, []) == []
    for rows in ([(3, 1, "user", "x")], [(5, 1, "u", "a"), (6, 1, "u", "a")], [(None, 1, "u", "a")], [(1, None, None, None)] * 3):
        assert _trie(spark, rows) == _brute_trie(rows)


def test_findclose_over_many_blocks():
    rnd = random.Random(3)
    depth = [0]
    while len(depth) < 3000:
        depth.append(rnd.randrange(max(1, depth[-1] - 2), depth[-1] + 2))
    made = prefix_trie.Parentheses(np.array(depth))
    for i, at in enumerate(made.opens.tolist()):
        end = next((j for j in range(i + 1, len(depth)) if depth[j] <= depth[i]), len(depth))
        assert made.bits[at] == 1 and made.rank[made.findclose(at)] == end


# --- language ID -------------------------------------------------------------

def _plain_symbols(text):
    text = "".join(c.lower() if c.isalpha() else " " for c in text)
    return " ".join(text.split()) + " " if text.strip() else ""


class _PlainModel:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        n = language_id.ORDER
        grams = [Counter() for _ in range(n + 1)]
        for t in map(_plain_symbols, texts):
            padded = " " * (n - 1) + t
            grams[n].update(padded[i - n + 1: i + 1] for i in range(n - 1, len(padded)))
        for k in range(n - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        self.grams, self.d, self.total, self.types = grams, {}, defaultdict(int), Counter()
        for k in range(1, n + 1):
            once, twice = (sum(c == x for c in grams[k].values()) for x in (1, 2))
            self.d[k] = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
            for g, c in grams[k].items():
                self.total[k, g[:-1]] += c
                self.types[k, g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / language_id.ALPHABET
        below, key = self.p(gram[1:]), (k, gram[:-1])
        if not self.total.get(key):
            return below
        return max(self.grams[k][gram] - self.d[k], 0) / self.total[key] + self.d[k] * self.types[key] / self.total[key] * below

    def bits(self, text):
        n = language_id.ORDER
        padded = " " * (n - 1) + _plain_symbols(text)
        return [-math.log2(self.p(padded[i - n + 1: i + 1])) for i in range(n - 1, len(padded))]


def test_models_equal_dictionaries():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "cat", "Hat", "ñandú", "x1y", "--", "straße"]) for _ in range(rnd.randrange(1, 20))) for _ in range(40)]
    raw, off = text_buffer(pa.array(texts))
    model, plain = language_id.fit(*language_id.symbols(raw, off)[::2]), _PlainModel(texts)
    asked = ["the cat", "The zebra hat", "", None, "123", "ñ", "q" * 50, *texts[:5], "中文 the"]
    for window in (7, 1 << 19):
        bits, count = language_id.entropies(*text_buffer(pa.array(asked)), language_id.Memo([model, model], window), window)
        for i, t in enumerate(asked):
            want = plain.bits(t or "")
            assert count[i] == len(want)
            assert bits[i, 0] == pytest.approx(np.mean(want) if want else 0.0, rel=1e-4) and bits[i, 0] == bits[i, 1]


def test_probabilities_sum_to_one():
    texts = ["abab abba", "baab", "a b"]
    raw, off = text_buffer(pa.array(texts))
    plain = _PlainModel(texts)
    seen = set("ab ")
    for history in ("", "a", "ab", " ab", "    "):
        unseen = (language_id.ALPHABET - len(seen)) * plain.p(history + "中")
        assert sum(plain.p(history + c) for c in seen) + unseen == pytest.approx(1.0)


def test_language_accuracy_and_score(spark):
    truth = {r.doc_id: r.lang for r in documents(spark, SF_MID).select("doc_id", "lang").collect()}
    got = QUERIES["op12_kneser_ney_language_id"](spark, SF_MID).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    sure = [r for r in held if r.score > 0.9]
    assert sum(r.lang_pred == truth[r.doc_id] for r in sure) >= 0.99 * len(sure) > 0.8 * len(held)


def _learnt(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en", "s") for i in range(30)] + [(i, "der hund und die katze auf der matte", "de", "s") for i in range(30, 60)]
    rows += [(61, None, "en", "s"), (62, "123", "de", "s"), (63, "etwas", None, "s"), (None, "the cat", "en", "s"), (None, "the cat", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, models string")


def test_language_edge_cases(spark):
    learnt = language_id.train(_learnt(spark), F.lit(True))
    assert learnt["languages"] == ["de", "en"]
    asked = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 34!", "k"), (4, "The dog", "k"), (4, "The dog", "k"), (None, "und der", "k"), (5, "the cat " * 40_000, "k"),
                                   (6, "́́", "k")], "doc_id long, text string, keys string")
    got = sorted(((r.doc_id, r._li_lang, r._li_symbols) for r in language_id.identify(asked, learnt).collect()), key=str)
    assert got == sorted([(1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 8), (4, "en", 8), (None, "de", 8), (5, "en", 320_000), (6, "und", 0)], key=str)
    assert language_id.identify(asked.limit(0), learnt).count() == 0


def test_nothing_learnt_is_undetermined(spark):
    learnt = language_id.train(_learnt(spark).limit(0), F.lit(True))
    got = language_id.identify(_learnt(spark), learnt).select("_li_lang", "_li_score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]


def test_equal_languages_go_to_the_least_name(spark):
    rows = spark.createDataFrame([(i, "same words here", lang) for i in range(40) for lang in ("xx", "aa")], "doc_id long, text string, lang string")
    learnt = language_id.train(rows, F.lit(True))
    learnt["models"][1] = learnt["models"][0]
    assert {r._li_lang for r in language_id.identify(rows, learnt).collect()} == {"aa"}


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_ROWS", 10)
    rows = spark.createDataFrame([(7, "one same row", "en")] * 5000 + [(i, f"row {'abcdefghij'[i % 10]} {i}", "de") for i in range(500)], "doc_id long, text string, lang string")
    got = Counter(r.lang for r in language_id.sample(rows, fold("doc_id", 3) >= 0).collect())
    assert got == {"en": 10, "de": 10}  # one text 5,000 times counts as at most MAX_ROWS of it
