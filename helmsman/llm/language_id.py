"""Language ID by interpolated Kneser-Ney character models.

Texts are lower-cased letters; every run of other characters is one space, with one
in front and one behind.  For each language an ``ORDER``-gram model gives

    p(c | h) = max(count(h c) - D, 0) / total(h) + D types(h) / total(h) p(c | h')

where h' drops the first character of h, counts below the highest order are numbers
of distinct left neighbours, D of each order is n1 / (n1 + 2 n2), and the unigrams
are interpolated with one over ``ALPHABET``.  A model is three aligned arrays sorted
by the n-grams' hashes (the order is part of the hash): probability, and weight of
the lower order when the n-gram is the history.  A text's language is that of the
lowest cross-entropy per character.

Calibration, on a tenth of the sample that no model has seen: a temperature turns
cross-entropies into the score, and for each language the excess of cross-entropy
over its mean (times the square root of the length) that ``REJECT`` of its own texts
stay below.  A text beyond it is ``rejected`` and its score is scaled down.

What is learnt comes from a bounded sample: in each language, in the order of a hash
of the id and text, at most ``MAX_ROWS`` rows of at most ``MAX_TEXT`` bytes, until
``SAMPLE_BYTES`` over the number of languages (``LANGUAGE_BYTES`` at most) are
reached.  So the models, which are broadcast, have at most ``ORDER * SAMPLE_BYTES``
entries of 16 bytes, and in practice a few hundred thousand.  Each language is fitted
in a task of its own.  Scoring reads every text whole, in windows of ``WINDOW``
characters.

Defined results: a null text and one without letters are ``und`` with score 0; so is
every text when nothing is labelled; ties go to the least language name; null
languages are not learnt from; a null id is in fold 0; repeated rows are scored per
row (and learnt from as often); an empty table gives no rows; other columns pass
through ``identify`` (its own start with ``_li_``).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold
from .registry import register
from .shared import U64, documents, mix, slices, small_side, text_buffer, written

ORDER = 5
MAX_ROWS, MAX_TEXT = 2_000, 64 << 10
SAMPLE_BYTES, LANGUAGE_BYTES = 8 << 20, 768 << 10
WINDOW = 1 << 19
REJECT = 0.999
CALIBRATION = 10  # one of so many sampled rows calibrates
MEMO = 1 << 19  # n-grams whose bits a task keeps
ALPHABET = 1 << 17  # about the letters of Unicode
SPACE = 32


# --- characters --------------------------------------------------------------

@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code of every letter and combining mark and a space for every
    other code point; which code points are letters."""
    out, letter = np.full(0x110000, SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x33000):  # no letters are assigned beyond
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            small = chr(c).lower()
            out[c], letter[c] = ord(small) if len(small) == 1 else c, kind == "L"
    return out, letter


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row of each, which are scored): each row as ORDER - 1 spaces, its
    letters with single spaces between words, and a closing space.  A row without
    letters has none that are scored."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]  # characters before each row
    rows = len(off) - 1
    lower, letters = _alphabet()
    row = np.repeat(np.arange(rows), np.diff(at))
    usable = np.bincount(row, letters[codes], minlength=rows) > 0
    codes = np.where(usable[row], lower[codes], np.uint32(SPACE))
    letter = codes != SPACE
    first = np.ones(len(codes), bool)
    first[1:] = (row[1:] != row[:-1])
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1] & ~first[1:]
    keep = letter | after  # the first space after a letter
    codes, row = codes[keep], row[keep]
    size = np.bincount(row, minlength=rows)
    ends = np.cumsum(size)
    closed = np.zeros(rows, bool)
    closed[size > 0] = codes[ends[size > 0] - 1] == SPACE
    more = (size > 0) & ~closed
    codes, row = np.insert(codes, ends[more], SPACE), np.insert(row, ends[more], np.flatnonzero(more))
    size = size + more
    starts = np.cumsum(size) - size
    pad = np.repeat(starts, ORDER - 1)
    scored = np.insert(np.ones(len(codes), bool), pad, False)
    return np.insert(codes, pad, SPACE), np.insert(row, pad, np.repeat(np.arange(rows), ORDER - 1)), scored


_PLACE = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ORDER)]


def grams(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` symbols that end at the positions ``at``."""
    total = np.full(len(at), n, U64)
    for k in range(n):
        total += (code[at - k].astype(U64) + U64(1)) * U64(_PLACE[k])
    return mix(total)


# --- a model -----------------------------------------------------------------

def fit(code: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
    """The model of a text of ``symbols``: sorted hashes, probability of each n-gram
    and weight of the lower order after it."""
    where = np.flatnonzero(scored)
    keys, at, count = np.unique(grams(code, where, ORDER), return_index=True, return_counts=True)
    at = where[at]
    orders = {ORDER: (keys, at, count.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):  # an n-gram's count is the number of (n + 1)-grams that end in it
        longer = orders[n + 1][1]
        keys, first, count = np.unique(grams(code, longer, n), return_index=True, return_counts=True)
        orders[n] = (keys, longer[first], count.astype(np.float64))
    root = np.zeros(0, U64)
    lower = {"keys": root, "p": np.zeros(0)}
    out_keys, out_p, out_weight = [], [], []
    for n in range(1, ORDER + 1):
        keys, at, count = orders[n]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
        history = grams(code, at - 1, n - 1) if n > 1 else np.zeros(len(at), U64)
        known, of = np.unique(history, return_inverse=True)
        total, types = np.bincount(of, count, len(known)), np.bincount(of, minlength=len(known))
        weight = discount * types / np.maximum(total, 1)
        if n == 1:
            below = np.full(len(at), 1.0 / ALPHABET)
        else:
            below = lower["p"][np.searchsorted(lower["keys"], grams(code, at, n - 1))]
        p = (count - discount) / total[of] + weight[of] * below
        if n == 1:
            first_weight = weight[0] if len(weight) else 1.0
        else:  # histories are (n - 1)-grams; those that end no longer n-gram keep weight 1
            here = np.searchsorted(lower["keys"], known)
            found = (here < len(lower["keys"])) & (lower["keys"][np.minimum(here, max(len(lower["keys"]) - 1, 0))] == known)
            out_weight[-1][here[found]] = weight[found]
            missing = ~found  # a history of leading spaces alone is no scored n-gram
            out_keys.append(known[missing])
            out_p.append(np.full(int(missing.sum()), np.nan))
            out_weight.append(weight[missing])
        out_keys.append(keys)
        out_p.append(p)
        out_weight.append(np.ones(len(keys)))
        lower = {"keys": keys, "p": p}
    keys, p, weight = np.concatenate(out_keys), np.concatenate(out_p), np.concatenate(out_weight)
    order = np.argsort(keys, kind="stable")
    return {"keys": keys[order], "p": p[order].astype(np.float32), "weight": weight[order].astype(np.float32), "unknown": np.float64(first_weight / ALPHABET)}


def log2_probability(model: dict[str, np.ndarray], found: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
    """log2 p of the last symbol of each n-gram; ``found[n - 1]`` and
    ``histories[n - 1]`` are the hashes of the n symbols that end at it and before it."""
    keys = model["keys"]

    def look(wanted):
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    at, known = look(found[0])
    p = np.where(known, model["p"][at] if len(keys) else 0.0, model["unknown"])
    for n in range(2, ORDER + 1):
        at, known = look(histories[n - 2])
        weight = np.where(known, model["weight"][at], 1.0)
        at, known = look(found[n - 1])
        own = model["p"][at]
        p = np.where(known & ~np.isnan(own), own, weight * p)
    return np.log2(p)


class Memo:
    """Bits of the n-grams that a task has met, sorted by hash; it starts again
    when it is full."""

    def __init__(self, models: list[dict], limit: int = MEMO):
        self.models, self.limit = models, limit
        self.keys, self.bits = np.zeros(0, U64), np.zeros((0, len(models)), np.float32)

    def of(self, keys: np.ndarray, found, histories) -> np.ndarray:
        """n-grams x models bits of the sorted distinct ``keys``; ``found(at, n)``
        and ``histories(at, n)`` give the hashes of n symbols for some of them."""
        here = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[here] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), len(self.models)), np.float32)
        out[known] = self.bits[here[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = [found(new, n) for n in range(1, ORDER + 1)], [histories(new, n) for n in range(1, ORDER)]
            for m, model in enumerate(self.models):
                out[new, m] = -log2_probability(model, a, b)
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.bits = keys, out
            else:
                merged = np.concatenate([self.keys, keys[new]])
                order = np.argsort(merged, kind="stable")
                self.keys, self.bits = merged[order], np.concatenate([self.bits, out[new]])[order]
        return out


def entropies(raw: np.ndarray, off: np.ndarray, memo: Memo, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows x models mean bits per symbol, symbols of each row)."""
    models = memo.models
    code, row, scored = symbols(raw, off)
    total, count = np.zeros((len(off) - 1, len(models))), np.bincount(row[scored], minlength=len(off) - 1)
    for low in range(ORDER - 1, len(code), window):
        high = min(len(code), low + window)
        here = code[low - ORDER + 1: high]
        take = np.flatnonzero(scored[low: high])
        if not len(take):
            continue
        take += ORDER - 1
        keys, first, back = np.unique(grams(here, take, ORDER), return_index=True, return_inverse=True)
        at = take[first]
        bits = memo.of(keys, lambda some, n: grams(here, at[some], n), lambda some, n: grams(here, at[some] - 1, n))  # noqa: B023
        rows = row[low - ORDER + 1: high][take]
        base = rows[0]
        for m in range(len(models)):
            sums = np.bincount(rows - base, bits[back, m])
            total[base: base + len(sums), m] += sums
    return total / np.maximum(count, 1)[:, None], count


# --- learning ----------------------------------------------------------------

def sample(docs: DataFrame, use: Column) -> DataFrame:
    """(lang, rank, text) of the rows that are learnt from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TEXT) & F.col("text").rlike(r"\p{L}"))
    narrow = docs.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size"))
    texts = written(narrow.groupBy("lang", "h", "size").agg(F.count(F.lit(1)).alias("times")), "languages")
    # About 2 MAX_ROWS texts of a language pass by their hash, whatever its share; only those are ranked.
    counts = written(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("all")), "languages")
    few = texts.join(small_side(counts), "lang").where((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("all") < 2 * MAX_ROWS)
    order = Window.partitionBy("lang").orderBy("h", "size")
    ranked = few.withColumn("rank", F.sum("times").over(order)).where(F.col("rank") - F.col("times") < MAX_ROWS)
    ranked = ranked.withColumn("before", F.sum(F.col("size") * F.col("times")).over(order) - F.col("size") * F.col("times"))
    ranked = written(ranked, "languages")
    languages = max(1, counts.count())
    budget = min(LANGUAGE_BYTES, SAMPLE_BYTES // languages)
    chosen = written(ranked.where(F.col("before") < budget).select("lang", "h", "rank", F.least("times", F.lit(MAX_ROWS)).alias("times")), "languages")
    texts = docs.withColumn("h", F.xxhash64("doc_id", "text")).join(small_side(chosen), ["lang", "h"])
    once = texts.groupBy("lang", "h").agg(F.first("rank").alias("rank"), F.first("times").alias("times"), F.first("text").alias("text"))
    return written(once.select("lang", "rank", F.explode(F.array_repeat("text", F.col("times").cast("int"))).alias("text")), "languages")


def _fit_task(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    model = fit(*symbols(*text_buffer(table["text"].combine_chunks()))[::2])
    columns = [table["lang"][:1].combine_chunks(), *(pa.array([model[k].tobytes()], pa.binary()) for k in ("keys", "p", "weight")), pa.array([float(model["unknown"])])]
    return pa.Table.from_arrays(columns, names=["lang", "keys", "p", "weight", "unknown"])


def train(docs: DataFrame, use: Column) -> dict:
    """Languages (sorted), their models, and the calibration."""
    rows = sample(docs, use)
    held = F.col("rank") % CALIBRATION == 0
    made = rows.where(~held).groupBy("lang").applyInArrow(_fit_task, "lang string, keys binary, p binary, weight binary, unknown double").collect()  # SAMPLE_BYTES bounds it
    made = sorted(made, key=lambda r: r["lang"])
    models = [{"keys": np.frombuffer(r["keys"], U64), "p": np.frombuffer(r["p"], np.float32), "weight": np.frombuffer(r["weight"], np.float32), "unknown": r["unknown"]} for r in made]
    learnt = {"languages": [r["lang"] for r in made], "models": models, "temperature": 1.0, "mean": np.zeros(len(made)), "limit": np.full(len(made), np.inf)}
    if models:
        checked = identify(rows.where(held), learnt).select("lang", "_li_bits", "_li_symbols").collect()  # at most MAX_ROWS / CALIBRATION a language
        calibrate(learnt, [(r["lang"], np.array(r["_li_bits"]), r["_li_symbols"]) for r in checked if r["_li_symbols"]])
    return learnt


def confidence(bits: np.ndarray, count: np.ndarray, temperature: float) -> np.ndarray:
    """Share of the best language, rows x languages."""
    gap = (bits - bits.min(1, keepdims=True)) * np.sqrt(np.maximum(count, 1))[:, None] * temperature
    weight = np.exp2(-np.minimum(gap, 60))
    return weight / weight.sum(1, keepdims=True)


def calibrate(learnt: dict, rows: list[tuple[str, np.ndarray, int]]) -> None:
    """Set the temperature (least log loss) and the rejection limits."""
    rows = [r for r in rows if r[0] in learnt["languages"]]
    if not rows:
        return
    truth = np.array([learnt["languages"].index(r[0]) for r in rows])
    bits, count = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    loss = {t: -np.log(np.maximum(confidence(bits, count, t)[np.arange(len(rows)), truth], 1e-9)).mean() for t in 2.0 ** np.arange(-4, 6)}
    learnt["temperature"] = min(loss, key=lambda t: (loss[t], t))
    for m in range(len(learnt["languages"])):
        own = truth == m
        if own.any():
            learnt["mean"][m] = np.average(bits[own, m], weights=count[own])
            learnt["limit"][m] = max(0.5, np.quantile((bits[own, m] - learnt["mean"][m]) * np.sqrt(count[own]), REJECT) * 1.5)


# --- the operator ------------------------------------------------------------

def identify(docs: DataFrame, learnt: dict) -> DataFrame:
    """``docs`` with _li_lang, _li_score, _li_rejected, _li_bits (per language) and
    _li_symbols."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    new = [T.StructField("_li_lang", T.StringType()), T.StructField("_li_score", T.DoubleType()), T.StructField("_li_rejected", T.BooleanType()),
           T.StructField("_li_bits", T.ArrayType(T.DoubleType())), T.StructField("_li_symbols", T.LongType())]

    def run(batches):
        known = shared.value
        names, memo = known["languages"], Memo(known["models"])
        for batch in slices(batches, "text"):
            n = batch.num_rows
            bits, count = entropies(*text_buffer(batch.column(batch.schema.names.index("text"))), memo)
            usable = (count > 0) & bool(names)
            if names:
                best = bits.argmin(1)  # the least name among equals, as names are sorted
                excess = (bits[np.arange(n), best] - known["mean"][best]) * np.sqrt(np.maximum(count, 1))
                rejected = usable & (excess > known["limit"][best])
                score = confidence(bits, count, known["temperature"])[np.arange(n), best]
                score = np.where(rejected, score * known["limit"][best] / np.maximum(excess, 1e-9), score)
            else:
                best, rejected, score = np.zeros(n, int), np.zeros(n, bool), np.zeros(n)
            lang = [names[b] if u else "und" for b, u in zip(best.tolist(), usable.tolist())]
            columns = [pa.array(lang, pa.string()), pa.array(np.where(usable, score, 0.0)), pa.array(rejected), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


@register("op12_kneser_ney_language_id")
def op12(spark, sf_dir):
    docs = documents(spark, sf_dir)
    learnt = train(docs, fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), learnt).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("_li_lang").alias("lang_pred"), F.col("_li_score").alias("score"),
        F.col("_li_rejected").alias("rejected"), F.array_min("_li_bits").alias("bits_per_symbol"))
