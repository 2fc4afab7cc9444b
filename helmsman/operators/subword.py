"""Corpus vocabulary and token-id encoding.

The vocabulary is one aggregate (term counts) plus distributed numbering in
(count desc, term) order; ids 0-3 are the special tokens.  Encoding deals the
raw texts into chunks of a bounded size by a hash of their id; only the distinct
terms of a chunk meet the vocabulary, and a chunk's ids meet its texts again in
one co-group, so no row per token is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_TOKENS
from ..session import fits
from .numbering import assign_ids

# FIXED VALUES: special token ids.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
SPECIALS = (("[PAD]", PAD), ("[UNK]", UNK), ("[CLS]", CLS), ("[SEP]", SEP))
TOKEN_RE = r"(?U)\w+|[^\w\s]"
BROADCAST_VOCAB_ROWS = 2_000_000
SALT = 16
CHUNK_BYTES = 16 << 20  # text bytes of a chunk, about


def tokens(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_RE), 0)


@dataclass
class Vocab:
    table: DataFrame  # (term, count, id)
    size: int


def build_vocab(corpus: DataFrame, text_col: str = "text") -> Vocab:
    counts = (corpus.select(F.explode(tokens(text_col)).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("count")))
    table = assign_ids(counts, [F.col("count").desc(), F.col("term").asc()], start=len(SPECIALS)).persist()
    return Vocab(table, table.count() + len(SPECIALS))


def _lookup(exploded: DataFrame, vocab: Vocab, on: str, value: str) -> DataFrame:
    v = vocab.table.select(F.col("term"), F.col("id"))
    if on == "id":
        v = v.unionByName(exploded.sparkSession.createDataFrame(SPECIALS, "term string, id long"))
    v = v.select(F.col(on).alias("_k"), F.col(value).alias("_val"))
    if fits(vocab.table, BROADCAST_VOCAB_ROWS):
        return exploded.join(F.broadcast(v), exploded[on] == v["_k"], "left").drop("_k")
    salted = exploded.withColumn("_s", F.pmod(F.xxhash64(F.col("_row"), F.col("pos")), F.lit(SALT)))
    vs = v.withColumn("_s", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")))
    return salted.join(vs, (salted[on] == vs["_k"]) & (salted["_s"] == vs["_s"]), "left").drop("_k", "_s")


def encode(df: DataFrame, vocab: Vocab, id_col: str, text_col: str = "text", max_length: int = MAX_TOKENS
           ) -> DataFrame:
    """(id, input_ids, attention_mask, n_tokens).  ``input_ids`` is
    [CLS] + the first ``max_length - 2`` token ids + [SEP]; unknown tokens map to
    [UNK]; an empty text gives empty lists.  ``n_tokens`` counts every token of
    the whole text."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks = max(parts, math.ceil(size / CHUNK_BYTES))
    base = (df.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_t"))
            .withColumn("_c", F.pmod(F.xxhash64("_row"), F.lit(chunks))).repartition(parts, "_c"))
    # a text's ids are looked up only as far as ``input_ids`` reaches
    cut = (base.select("_c", "_row", tokens("_t").alias("_w"))
           .select("_c", "_row", F.slice("_w", 1, max_length - 2).alias("toks"), F.size("_w").cast("long").alias("n")))
    met = cut.select(F.col("_c").alias("_k"), F.explode("toks").alias("term")).distinct()
    known = met.join(vocab.table.select("term", F.col("id").cast("long").alias("id")), "term").select("_k", "term", "id")
    row = T.StructField("_row", df.schema[id_col].dataType)
    schema = T.StructType([row, T.StructField("input_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType())])
    made = cut.groupBy("_c").cogroup(known.groupBy("_k")).applyInArrow(_encode_chunk(max_length - 2), schema)
    return made.select(F.col("_row").alias(id_col), "input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), "n_tokens")


def _encode_chunk(most: int):
    """(texts' first tokens, ids of the chunk's terms) -> id lists."""

    def run(texts: pa.Table, terms: pa.Table) -> pa.Table:
        rows, lists = texts["_row"].combine_chunks().dictionary_encode(null_encoding="encode"), texts["toks"].combine_chunks()
        group, groups = rows.indices.to_numpy(zero_copy_only=False), len(rows.dictionary)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        ids = np.concatenate([terms["id"].to_numpy(), [UNK]])[at][coded.indices.to_numpy(zero_copy_only=False)]  # -1: the last
        owner, place = np.repeat(group, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((ids, place, owner))  # texts of one id count together, by place and id
        owner, ids = owner[order], ids[order]
        held = np.bincount(owner, minlength=groups)
        body = np.arange(len(ids)) - np.repeat(np.cumsum(held) - held, held) < most
        owner, ids, kept = owner[body], ids[body], np.minimum(held, most)
        total = np.bincount(group, texts["n"].to_numpy(), minlength=groups).astype(np.int64)
        length = np.where(total > 0, kept + 2, 0)
        ends = np.cumsum(length)
        out, some = np.zeros(length.sum(), np.int64), total > 0
        out[(ends - length)[some]], out[ends[some] - 1] = CLS, SEP
        out[np.arange(len(ids)) - np.repeat(np.cumsum(kept) - kept, kept) + (ends - length)[owner] + 1] = ids
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))
        return pa.table({"_row": rows.dictionary, "input_ids": made, "n_tokens": pa.array(total)})

    return run


def pad_batch(encoded: DataFrame) -> DataFrame:
    """Pad every id list with [PAD] (mask 0) to the longest in the batch."""
    longest = encoded.agg(F.max(F.size("input_ids"))).first()[0] or 0
    pad = F.greatest(F.lit(longest) - F.size("input_ids"), F.lit(0))
    return encoded.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD).cast("long"), pad))) \
                  .withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), pad)))


def decode(encoded: DataFrame, vocab: Vocab, id_col: str, skip_special: bool = True) -> DataFrame:
    """Ids back to space-joined tokens, in order."""
    ex = encoded.select(F.col(id_col).alias("_row"), F.posexplode("input_ids").alias("pos", "id"))
    if skip_special:
        ex = ex.filter(F.col("id") >= len(SPECIALS))
    j = _lookup(ex, vocab, "id", "term")
    g = j.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_val").alias("t")))).alias("_p"))
    return g.select(F.col("_row").alias(id_col), F.array_join(F.transform("_p", lambda x: x["t"]), " ").alias("text"))
