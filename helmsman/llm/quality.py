"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, of the character
3- to 5-grams of its words (with the word's boundaries) and of an end token; a
word equal to the one before it also counts one shared repeat token.  Vectors
are hashed into two tables, the output is a softmax over two classes, and both
are trained by numpy stochastic gradient descent on a bounded labelled sample.

The softmax of two classes over an average is the logistic of an average, so the
model that is broadcast holds one number per slot (its vector times the
difference of the output rows): ``2 << BITS`` floats, whatever the input size.

Defined results: null and empty texts are the end token alone; without usable
labels the score is 0.5; repeated rows are scored per row; other columns pass
through ``score`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmsman.session import sf_path

from .labelled import fold, labelled
from .registry import register
from .shared import U64, documents, slices

BITS = 18  # slots of each of the two tables
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
EPOCHS, RATE = 5, 0.5
MAX_LABELLED, MAX_BYTES = 8_000, 8 << 20  # rows that are learnt from, and bytes of their texts
SLICE = 1 << 18  # text bytes whose features a task holds at once
THRESHOLD = 0.3
END, REPEAT = 0, 1  # slots 0 and 1 of the word table are reserved

_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_PLACE = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def _slots(hashes: np.ndarray, table: int) -> np.ndarray:
    hashes = (hashes ^ (hashes >> U64(29))) * _MULTIPLIER
    slot = (hashes >> U64(64 - BITS)).astype(np.int32)
    return np.maximum(slot, 2) if table == 0 else slot + (1 << BITS)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) arrays of every feature of ``texts``, repeats included."""
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    row_at = np.concatenate([[0], np.cumsum(size + 1)])  # the line feed before each row
    space = (code == 32) | ((code >= 9) & (code <= 13))
    edge = np.diff((~space).view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_row = np.searchsorted(row_at, starts, "right") - 1
    letters = np.where(space, U64(32), code.astype(U64))
    out = [(np.arange(len(texts)), np.full(len(texts), END, np.int32))]
    if len(starts):
        running = np.cumsum(letters * _powers(len(letters)), dtype=U64)
        words = (running[ends - 1] - running[starts - 1]) * _inverse(len(letters))[starts]
        out.append((word_row, _slots(words, 0)))
        again = (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])
        out.append((word_row[1:][again], np.full(int(again.sum()), REPEAT, np.int32)))
        row = np.repeat(np.arange(len(texts)), size + 1)
        row = np.concatenate([row, [max(len(texts) - 1, 0)]])
        for n in NGRAMS:  # a boundary may be the first or last character, never an inner one
            m = len(letters) - n + 1
            if m <= 0:
                continue
            total = letters[:m] * _PLACE[0]
            inner = np.ones(m, bool)
            for k in range(1, n):
                total += letters[k: k + m] * _PLACE[k]
                if k < n - 1:
                    inner &= ~space[k: k + m]
            out.append((row[1: m + 1][inner], _slots(total[inner] + U64(n), 1)))
    return out


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    return _grown("p", 0x9E3779B97F4A7C15, n)


def _inverse(n: int) -> np.ndarray:
    return _grown("i", pow(0x9E3779B97F4A7C15, -1, 1 << 64), n)


def _grown(key: str, base: int, n: int) -> np.ndarray:
    if len(_tables.get(key, ())) < n:
        powers = np.full(max(n, 1 << 20), base, U64)
        powers[0] = 1
        _tables[key] = np.cumprod(powers, dtype=U64)
    return _tables[key][:n]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _emit(batches):
    for batch in slices(batches, "text", SLICE):
        parts = features(_texts(batch))
        row, slot = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(row, kind="stable")
        counted = [np.unique(p, return_counts=True) for p in np.split(slot[order], np.searchsorted(row[order], np.arange(1, batch.num_rows)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c[0] for c in counted], pa.list_(pa.int32())), pa.array([c[1].astype(np.int32) for c in counted], pa.list_(pa.int32()))], names=["doc_id", "label", "slots", "counts"])


def fit(examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """One float per slot: its vector times the difference of the output rows."""
    rng = np.random.default_rng(11)
    vectors = ((rng.random((2 << BITS, DIMENSIONS), np.float32) - 0.5) * (2 / DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    examples = sorted(examples, key=lambda e: (e[0], e[1]))
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(examples)):
            _, label, slots, counts = examples[at]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[slots]
            logits = output @ hidden
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(label)] -= 1  # gradient of the loss
            p *= RATE * (1 - done / steps)
            step = p @ output
            output -= np.outer(p, hidden)
            vectors[slots] -= np.outer(np.minimum(share * len(slots), 1.0), step)
            done += 1
    return (vectors @ (output[1] - output[0])).astype(np.float32)


def _fit_task(batches):
    examples = [(d, y, np.asarray(s.values, np.int32), np.asarray(c.values, np.int32)) for b in batches
                for d, y, s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))]
    yield pa.RecordBatch.from_arrays([pa.array([fit(examples).tobytes()], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, label: str, use, limit: int = MAX_LABELLED) -> np.ndarray:
    made = labelled(docs, labels, label, use, limit, MAX_BYTES).mapInArrow(_emit, "doc_id long, label int, slots array<int>, counts array<int>")
    return np.frombuffer(made.repartition(1).mapInArrow(_fit_task, "model binary").first()["model"], np.float32)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` with ``_quality`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shared.value
        for batch in slices(batches, "text", SLICE):
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for row, slot in features(_texts(batch)):
                total += np.bincount(row, table[slot], minlength=batch.num_rows)
                count += np.bincount(row, minlength=batch.num_rows)
            value = 1.0 / (1.0 + np.exp(-np.clip(total / count, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, "_quality"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_quality", T.DoubleType())]))


def quality_model(spark, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """The model of the quality labels, learnt off the fifth that is held out."""
    return train(docs, spark.read.parquet(sf_path(sf_dir, "labels")), "quality", fold("doc_id", 5) != 0)


@register("op8_subword_quality")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, quality_model(spark, docs, sf_dir)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("_quality").alias("score"),
        (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"))
