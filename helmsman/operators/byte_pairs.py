"""Subword ids (T1-T4) from the vocabulary file of a public byte-level tokenizer.

Nothing is trained: a vocabulary is a file of lines ``base64(bytes) rank`` whose path
is a parameter.  It has every single byte, so no text has unknown parts and decoding
gives the text back.

Texts are cut into words by one regular expression on the JVM; what is shuffled is the
texts, once, by their id.  Where a text's words are, every **distinct** word of a batch
is encoded once (a task remembers those it has met, up to ``BROADCAST_WORDS``): its bytes
are merged pair by pair, the pair of the lowest rank first.  Decoding is a lookup in the
broadcast vocabulary, text by text.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_TOKENS

VOCABULARY = os.environ.get("HELMSMAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# FIXED VALUE: the word pattern that belongs to the vocabulary ((?U): Unicode classes).
WORD = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BROADCAST_WORDS = 200_000  # distinct words a task remembers
ROWS = 512  # ids encoded or decoded at once


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.ranks)

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, bytes)"""
        return spark.createDataFrame([(i, bytearray(b)) for b, i in self.ranks.items()], "id int, bytes binary")


def load(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file that the driver can open (its size bounds what is
    broadcast)."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the lowest rank is merged first, the
    leftmost among equals."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i: i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1]: best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


LONG = 256


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merged``, for words of many bytes: pairs wait in a heap, so the time grows
    with n log n."""
    import heapq

    n = len(word)
    start, after, before, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = [i + 1 for i in range(n)]
    heap = [(ranks[word[i: i + 2]], i, i + 2) for i in range(n - 1) if word[i: i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (pair := word[start[left]: end[after[left]]]) in ranks:
                heapq.heappush(heap, (ranks[pair], left, end[after[left]]))
    return [ranks[word[start[i]: end[i]]] for i in range(n) if alive[i]]


def words(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(WORD), 0)


def _shared(spark: SparkSession, value):
    try:  # shipped once per executor
        sent = spark.sparkContext.broadcast(value)
        return lambda: sent.value
    except Exception:  # sessions without a SparkContext: with the task
        return lambda: value


def _word_ids(found: list[str], ranks: dict[bytes, int], known: dict[str, list[int]]) -> list[list[int]]:
    """Ids of the distinct words ``found``; ``known`` are the words met before."""
    if len(known) > BROADCAST_WORDS:
        known.clear()
    made = []
    for word in found:
        ids = known.get(word)
        if ids is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = merged(raw, ranks) if len(raw) < LONG else merged_long(raw, ranks)
            if len(raw) < LONG:
                known[word] = ids
        made.append(ids)
    return made


def _encoded(part: pa.RecordBatch, ranks: dict[bytes, int], known: dict[str, list[int]], max_length: int) -> pa.RecordBatch:
    """(id, the words of its texts) -> (id, input_ids, n_tokens)."""
    n, texts = part.num_rows, part.column(1)
    lists = texts.flatten()
    words_of_text, texts_of_row = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (lists, texts))
    coded = lists.flatten().dictionary_encode()
    made = _word_ids(coded.dictionary.to_pylist(), ranks, known)
    length, value = np.array([len(x) for x in made], np.int64), np.array([i for x in made for i in x], np.int32)
    code = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(n), texts_of_row), words_of_text)
    if (texts_of_row > 1).any():  # texts of one id count together, by place and ids
        place = np.arange(len(code)) - np.repeat(np.cumsum(words_of_text) - words_of_text, words_of_text)
        by_ids = np.empty(len(made), np.int64)
        by_ids[sorted(range(len(made)), key=made.__getitem__)] = np.arange(len(made))
        code = code[np.lexsort((by_ids[code], place, row))]
    size = length[code]
    total = np.bincount(row, size, minlength=n).astype(np.int64)
    ids = value[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat((np.cumsum(length) - length)[code], size)]
    kept = np.minimum(total, max_length)
    if (kept < total).any():
        ids = ids[np.arange(len(ids)) - np.repeat(np.cumsum(total) - total, total) < max_length]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(ids, pa.int32()))
    return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(total)], names=["_row", "input_ids", "n_tokens"])


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str = "text", max_length: int = MAX_TOKENS) -> DataFrame:
    """(id, input_ids, attention_mask, n_tokens).  ``input_ids`` are the first
    ``max_length`` ids, ``n_tokens`` counts those of the whole text; a null or empty
    text has none."""
    get = _shared(df.sparkSession, vocabulary.ranks)

    def run(batches):
        known: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _encoded(batch.slice(at, ROWS), get(), known, max_length)

    texts = df.groupBy(F.col(id_col).alias("_row")).agg(F.collect_list(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_t"))
    schema = T.StructType([T.StructField("_row", df.schema[id_col].dataType), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    made = texts.select("_row", F.transform("_t", words)).mapInArrow(run, schema)
    return made.select(F.col("_row").alias(id_col), "input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), "n_tokens")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str) -> DataFrame:
    """(id, text); a sequence that was cut inside a character ends in U+FFFD."""
    get = _shared(encoded.sparkSession, {i: b for b, i in vocabulary.ranks.items()})

    def run(batches):
        table = get()
        for batch in batches:
            raw = [b"".join([table.get(i, b"") for i in ids or ()]) for at in range(0, batch.num_rows, ROWS) for ids in batch.column(1).slice(at, ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["_row", "raw"])

    schema = T.StructType([T.StructField("_row", encoded.schema[id_col].dataType), T.StructField("raw", T.BinaryType())])
    return encoded.select(id_col, "input_ids").mapInArrow(run, schema).select(F.col("_row").alias(id_col), F.col("raw").cast("string").alias("text"))
