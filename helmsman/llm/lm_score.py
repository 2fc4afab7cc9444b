"""LM scoring by cross-entropy difference.

A target and a background model of the same order, smoothing and vocabulary
(words and word pairs) give each token a loss; a document's score is the mean
loss under the target model less that under the background model, in bits per
token (lower: closer to the target).  The target is every document labelled good,
the background every document.  A document's own counts are left out of each
model that counted it, so membership alone does not decide its score.

    p1(w) = (1 - FLOOR) c(w) / N + FLOOR / V
    p(w | v) = MIX c(v, w) / c(v) + (1 - MIX) p1(w)   (p1 alone after no or an unseen v)

Counts are exact and grow with the corpus; no model is held in one place.

1. Documents are dealt into blocks of about ``BLOCK_BYTES`` of text.  A block
   counts its distinct n-grams once and sends them, packed by ranges of their
   hash, so a word of every document is one entry per block.  The hash has 20
   bits more than the corpus has bytes, 64 at most: an n-gram shares it with
   another one with a chance below 1e-6.
2. The task that owns a range (about ``RANGE_BYTES`` of the corpus) sums the
   entries of all blocks and answers each block with the totals of its entries.
3. Each block meets its answers and scores its documents.

Blocks and ranges keep their size whatever the input's; only the three sums N
(of either model) and V pass through the driver.

Defined results: null and wordless texts have 0 tokens and score 0; a null id or
label is not in the target; several labels of one id count as their largest; an
empty target gives every token FLOOR / V; repeated rows count and are scored per
row, and only the row itself is left out; an empty table gives no rows; other
columns pass through ``score`` (its own start with ``_lm_``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmsman.session import sf_path

from .registry import register
from .shared import ALNUM, SLICE_BYTES, U64, chain, column_bytes, documents, slices, small_side, span_hashes, split_words, text_buffer, written

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
MIX, FLOOR = 0.5, 0.01


def tokens(raw: np.ndarray, off: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, pair, paired) per token: hashes of ``width`` bits of the word
    (odd) and of the pair that ends here (even), and whether there is one."""
    buf, starts, ends, bounds = split_words(raw, off, ALNUM)
    words = span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    pair, paired = np.zeros(len(words), U64), np.zeros(len(words), bool)
    if len(words) > 1:
        pair[1:] = chain(words[:-1], words[1:]) >> U64(64 - width) & ~U64(1)
        paired[1:] = row[1:] == row[:-1]
    return row, words >> U64(64 - width) | U64(1), pair, paired


# --- counting ----------------------------------------------------------------

def _summed(keys: np.ndarray, target: np.ndarray, background: np.ndarray):
    """(distinct keys, their sums, where each key went)."""
    keys, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, c, len(keys)).astype(np.int64) for c in (target, background)]
    return keys, sums[0], sums[1], at


def _counted(raw: np.ndarray, off: np.ndarray, inside: np.ndarray, width: int = 64):
    row, word, pair, paired = tokens(raw, off, width)
    target = inside[row]
    keys, target = np.concatenate([word, pair[paired]]), np.concatenate([target, target[paired]])
    return _summed(keys, target, np.ones(len(keys)))[:3]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as compressed byte planes."""
    planes = np.concatenate([c.view(np.uint8).reshape(-1, 8).T for c in columns])
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(raw: bytes, n: int, columns: int, kind=np.int64) -> list[np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, decompressed_size=8 * n * columns), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(kind).ravel() for p in planes]


_REQUEST = pa.schema([("_lm_block", pa.int64()), ("_lm_range", pa.int64()), ("_lm_n", pa.int64()), ("_lm_keys", pa.binary()), ("_lm_counts", pa.binary())])
_REQUEST_SQL = [T.StructField(n, T.BinaryType() if n in ("_lm_keys", "_lm_counts") else T.LongType()) for n in _REQUEST.names]


def _ranges(keys: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(range, first index) of the ranges that the sorted ``keys`` fall in."""
    of = (keys >> U64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return np.unique(of, return_index=True)


def _block_task(bits: int, width: int, limit: int):
    """The documents with their block, and after each block its packed entries."""

    def requests(block, parts, schema):
        keys, target, background, _ = _summed(*(np.concatenate(x) for x in zip(*parts)))
        of, first = _ranges(keys, bits, width)
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))
        for at in range(0, len(spans), 1024):
            some = spans[at: at + 1024]
            made = [pa.array([block] * len(some), pa.int64()), pa.array(of[at: at + 1024]), pa.array([b - a for a, b in some], pa.int64()),
                    pa.array([pack(np.diff(keys[a:b], prepend=U64(0))) for a, b in some], pa.binary()),
                    pa.array([pack(target[a:b], background[a:b]) for a, b in some], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), f.type) for f in schema), *made], names=[*schema.names, *_REQUEST.names])

    def run(batches):
        from pyspark import TaskContext

        block, size, parts, schema = TaskContext.get().partitionId() << 32, 0, [], None
        for batch in slices(batches, "text", min(limit, SLICE_BYTES)):
            schema, n = batch.schema, batch.num_rows
            raw, off = text_buffer(batch.column(schema.names.index("text")))
            if parts and size + len(raw) > limit:
                yield from requests(block, parts, schema)
                block, size, parts = block + 1, 0, []
            size += len(raw)
            parts.append(_counted(raw, off, np.array(batch.column(schema.names.index("_lm_target")).to_pylist(), bool), width))
            own = [pa.array([block] * n, pa.int64()), *(pa.nulls(n, f.type) for f in list(_REQUEST)[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*schema.names, *_REQUEST.names])
        if parts:
            yield from requests(block, parts, schema)

    return run


# --- totals ------------------------------------------------------------------

_ANSWER = pa.schema([("_lm_block", pa.int64()), ("_lm_range", pa.int64()), ("_lm_n", pa.int64()), ("_lm_totals", pa.binary()),
                     ("words", pa.int64()), ("target", pa.int64()), ("background", pa.int64())])
_ANSWER_SQL = "_lm_block long, _lm_range long, _lm_n long, _lm_totals binary, words long, target long, background long"


def _answers(of: int, rows: list) -> pa.RecordBatch:
    """Totals for every row (block, n, keys, counts) of one range, and one row of
    its distinct words and its tokens in either model."""
    keys = np.concatenate([np.cumsum(unpack(k, n, 1, U64)[0], dtype=U64) for _, n, k, _ in rows])
    target, background = (np.concatenate(c) for c in zip(*(unpack(c, n, 2) for _, n, _, c in rows)))
    distinct, target, background, at = _summed(keys, target, background)
    word = (distinct & U64(1)).astype(bool)
    parts = np.split(at, np.cumsum([n for _, n, _, _ in rows])[:-1])
    made = [(block, of, n, pack(target[p], background[p]), None, None, None) for (block, n, _, _), p in zip(rows, parts)]
    made.append((None, of, None, None, int(word.sum()), int(target[word].sum()), int(background[word].sum())))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ANSWER)], schema=_ANSWER)


def _range_task(batches):
    """Rows sorted by range -> answers; one range in memory at a time."""
    of, rows = None, []
    for batch in batches:
        for row in zip(*batch.columns):
            block, this, n, keys, counts = (x.as_py() for x in row)
            if this != of:
                if rows:
                    yield _answers(of, rows)
                of, rows = this, []
            rows.append((block, n, keys, counts))
    if rows:
        yield _answers(of, rows)


# --- scoring -----------------------------------------------------------------

def losses(row, word, pair, paired, inside, totals, sums, vocabulary) -> np.ndarray:
    """(2, tokens) losses in bits under the two models, own counts left out.
    ``word`` and ``pair`` are indexes into ``totals``."""
    n = np.bincount(row, minlength=len(inside))

    def own(row, key):
        _, back, count = np.unique(row.astype(np.int64) * totals.shape[1] + key, return_inverse=True, return_counts=True)
        return count[back]

    own_word, own_pair = own(row, word), np.zeros(len(word), np.int64)
    own_pair[paired] = own(row[paired], pair[paired])
    out = np.empty((2, len(word)))
    for m in (0, 1):
        less = inside[row].astype(np.int64) if m == 0 else np.ones(len(word), np.int64)
        total = sums[m] - n[row] * less
        p1 = (1 - FLOOR) * (totals[m, word] - own_word * less) / np.maximum(total, 1) + FLOOR / max(1, vocabulary)
        context = np.zeros(len(word), np.int64)
        context[1:] = (totals[m, word] - own_word * less)[:-1]
        context[~paired] = 0
        follows = totals[m, pair] - own_pair * less
        share = np.minimum(1.0, follows / np.maximum(context, 1))
        out[m] = -np.log2(np.where(context > 0, MIX * share + (1 - MIX) * p1, p1))
    return out


def _score_task(names: list[str], width: int, sums: tuple[int, int], vocabulary: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        sliced = list(slices(docs.to_batches(), "text"))
        found = [tokens(*text_buffer(batch.column(batch.schema.names.index("text"))), width) for batch in sliced]
        keys = np.unique(np.concatenate([np.zeros(0, U64), *(x for _, word, pair, paired in found for x in (word, pair[paired]))]))
        answers = answers.sort_by("_lm_range")
        parts = [unpack(t.as_py(), n.as_py(), 2) for n, t in zip(answers["_lm_n"], answers["_lm_totals"])]
        totals = np.array([np.concatenate([np.zeros(0, np.int64), *(p[m] for p in parts)]) for m in (0, 1)])
        if totals.shape[1] != len(keys):
            raise RuntimeError(f"a block has {len(keys)} n-grams but {totals.shape[1]} totals")
        out = []
        for batch, (row, word, pair, paired) in zip(sliced, found):
            inside = np.array(batch.column(batch.schema.names.index("_lm_target")).to_pylist(), bool)
            n = np.bincount(row, minlength=batch.num_rows)
            word, pair = np.searchsorted(keys, word), np.where(paired, np.searchsorted(keys, pair), 0)
            bits = [np.bincount(row, x, minlength=batch.num_rows) / np.maximum(n, 1)
                    for x in losses(row, word, pair, paired, inside, totals, sums, vocabulary)]
            out.append(pa.Table.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), *map(pa.array, bits)],
                                            names=[*names, "_lm_tokens", "_lm_target_bits", "_lm_background_bits"]))
        return pa.concat_tables(out)

    return run


def flagged(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` with ``_lm_target``: whether the document is labelled 1."""
    good = written(labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_lm_id")).distinct(), "lm")
    return (docs.join(small_side(good), F.col("doc_id").cast("long") == F.col("_lm_id"), "left")
            .withColumn("_lm_target", F.col("_lm_id").isNotNull()).drop("_lm_id"))


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` (with _lm_target) with _lm_tokens, _lm_target_bits and
    _lm_background_bits (per token)."""
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    size = max(1, column_bytes(docs, "text"))
    bits, width = max(0, math.ceil(math.log2(size / range_bytes))), min(64, math.ceil(math.log2(size)) + 20)
    dealt = written(docs.mapInArrow(_block_task(bits, width, block_bytes), T.StructType([*fields, *_REQUEST_SQL])), "lm", "zstd")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = dealt.where("_lm_range is not null").select(*_REQUEST.names).repartition(parts, "_lm_range").sortWithinPartitions("_lm_range")
    answers = written(entries.mapInArrow(_range_task, _ANSWER_SQL), "lm")
    vocabulary, *sums = (x or 0 for x in answers.where("_lm_block is null").agg(F.sum("words"), F.sum("target"), F.sum("background")).first())
    rows = dealt.where("_lm_range is null").select(*[F.col(f"`{c}`") for c in docs.columns], "_lm_block")
    totals = answers.where("_lm_block is not null").select("_lm_block", "_lm_range", "_lm_n", "_lm_totals")
    more = [T.StructField("_lm_tokens", T.LongType()), T.StructField("_lm_target_bits", T.DoubleType()), T.StructField("_lm_background_bits", T.DoubleType())]
    task = _score_task(docs.columns, width, tuple(sums), vocabulary)
    return rows.groupBy("_lm_block").cogroup(totals.groupBy("_lm_block")).applyInArrow(task, T.StructType([*rows.schema.fields[:-1], *more]))


@register("op9_cross_entropy_difference")
def op9(spark, sf_dir):
    docs = flagged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(sf_path(sf_dir, "labels")))
    return score(docs).select(
        "doc_id", F.col("_lm_tokens").alias("n_tokens"), F.col("_lm_target").alias("in_target"),
        F.col("_lm_target_bits").alias("target_bits"), F.col("_lm_background_bits").alias("background_bits"),
        (F.col("_lm_target_bits") - F.col("_lm_background_bits")).alias("score"))
