"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features are the presence of hashed words, word pairs and pairs with one word
skipped.  Feature arrays of a bounded labelled sample are made in parallel; one
task runs FTRL-proximal (per-coordinate rates, L1 sparsity), so most weights are
exactly zero and the model that is broadcast is a short list of (slot, weight),
at most 2**BITS of them.  Scoring is one narrow pass over the documents.

Defined results: null and empty texts have no features and score the bias;
without usable labels the score is 0.5; repeated rows are scored per row; other
columns pass through ``score`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmsman.session import sf_path

from .labelled import MAX_LABELLED, fold, labelled
from .registry import register
from .shared import ALNUM, U64, chain, documents, slices, span_hashes, split_words, text_buffer

BITS = 22
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
EPOCHS = 8
THRESHOLD = 0.7


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, word pair and skip pair, repeats included."""
    buf, starts, ends, bounds = split_words(raw, off, ALNUM)
    words = span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    rows, slots = [row], [chain(words)]
    for gap, kind in ((1, 2), (2, 3)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        slots.append(chain(words[:-gap], words[gap:], np.full(1, kind, U64))[same])
    return np.concatenate(rows), (np.concatenate(slots) >> U64(64 - bits)).astype(np.int32)


def _emit(batches):
    for batch in slices(batches, "text"):
        raw, off = text_buffer(batch.column(1))
        row, slot = features(raw, off)
        order = np.argsort(row, kind="stable")
        parts = np.split(slot[order], np.searchsorted(row[order], np.arange(1, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([np.unique(p) for p in parts], pa.list_(pa.int32()))], names=["doc_id", "label", "slots"])


def fit(examples: list[tuple[int, int, np.ndarray]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal: (slots, weights, bias) of the non-zero coordinates.  The
    last coordinate is the bias, which has no L1 penalty."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rng = np.random.default_rng(7)

    def weight(i, l1):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    examples = sorted(examples, key=lambda e: (e[0], e[1]))
    penalty = {}
    for _ in range(EPOCHS):
        for at in rng.permutation(len(examples)):
            doc, label, slots = examples[at]
            i = np.append(slots, 1 << bits)
            l1 = penalty.setdefault(len(i), np.append(np.full(len(slots), L1), 0.0))
            w = weight(i, l1)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = weight(np.arange(1 << bits), L1)
    kept = np.flatnonzero(every)
    return kept, every[kept], float(weight(np.array([1 << bits]), 0.0)[0])


def _fit_task(batches):
    examples = [(d, y, np.asarray(s.values, np.int32)) for b in batches
                for d, y, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
    slots, weights, bias = fit(examples)
    yield pa.RecordBatch.from_arrays([pa.array([slots], pa.list_(pa.int32())), pa.array([weights], pa.list_(pa.float64())), pa.array([bias])], names=["slots", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, label: str, use, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    made = labelled(docs, labels, label, use, limit).mapInArrow(_emit, "doc_id long, label int, slots array<int>")
    model = made.repartition(1).mapInArrow(_fit_task, "slots array<int>, weights array<double>, bias double").first()
    return np.array(model["slots"], np.int32), np.array(model["weights"], np.float64), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` with ``_toxicity`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        slots, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float64)
        table[slots] = weights
        for batch in slices(batches, "text"):
            raw, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            row, slot = features(raw, off)
            hit = table[slot] != 0
            once = np.unique(row[hit].astype(np.int64) << BITS | slot[hit])
            total = bias + np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=[*batch.schema.names, "_toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_toxicity", T.DoubleType())]))


@register("op6_ftrl_toxicity")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(sf_path(sf_dir, "labels")), "toxic", fold("doc_id", 3) != 1)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))
