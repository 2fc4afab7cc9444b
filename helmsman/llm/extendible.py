"""Sharding by extendible hashing, with DataFrame operations only.

The directory is indexed by the first bits of a document's hash; several entries
may point at one bucket.  A bucket of more than ``limit`` bytes splits on its
next bit, the others keep their depth, until every bucket holds at most
``limit`` bytes or a single document.  Bytes are summed once per directory entry
and rolled up to every shorter prefix; the bucket of an entry is its shortest
prefix that fits.  Only documents of entries that are too large at the
directory's last bit enter the next, deeper directory.

The hash is 60 bits of md5(doc_id), then 60 bits of a hash of the whole row, so
rows that repeat one id, even as a third of the table, split as well.

Defined results: null texts have no bytes; a document above the limit is a shard
of its own (``shard_docs`` = 1); a null id hashes like an empty string; identical
rows are spread over shards in any order; an empty table gives no rows; other
columns pass through ``assign`` untouched (its own columns start with ``_eh_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import register
from .shared import documents, small_side, written

SHARD_BYTES = 1 << 20
ID_BITS, ALL_BITS = 60, 120
DIRECTORY_BITS = 20  # bits that one directory adds at most


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _eh_hash (120 bits as 0/1 text) and _eh_bytes."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    by_id = F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), ID_BITS, "0")
    by_row = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    return docs.withColumns({
        "_eh_hash": F.concat(by_id, F.lpad(F.bin(F.shiftrightunsigned(by_row, 4)), ALL_BITS - ID_BITS, "0")),
        "_eh_bytes": F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long"),
    })


def _prefix(bits: int) -> Column:
    return F.substring("_eh_hash", 1, bits)


def _directory(rows: DataFrame, start: int, bits: int, limit: int) -> DataFrame:
    """Entries (cell, bucket): ``cell`` is a prefix of start + bits bits, and
    ``bucket`` its shortest prefix that fits, longer than ``start`` unless that
    is 0; null where no prefix fits."""
    cells = written(rows.groupBy(_prefix(start + bits).alias("cell")).agg(F.sum("_eh_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "extendible")
    lengths = F.sequence(F.lit(start + 1 if start else 0), F.lit(start + bits))
    below = cells.select("cell", "b", "n", F.explode(F.transform(lengths, lambda d: F.col("cell").substr(F.lit(1), d))).alias("shard"))
    sums = below.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.length("shard") == ALL_BITS)
    found = F.struct(F.length("shard").alias("depth"), "shard", "shard_bytes", "shard_docs")
    return below.select("cell", "shard").join(sums, "shard").groupBy("cell").agg(F.min(F.when(fits, found)).alias("bucket"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with _eh_bytes (its own) and _eh_bucket: depth (bits), shard (the
    bits), shard_bytes and shard_docs of its shard."""
    rows, start, left = _keyed(docs), 0, None
    slim = written(rows.select("_eh_hash", "_eh_bytes"), "extendible")
    directories: list[tuple[int, DataFrame]] = []
    while True:
        total = slim.agg(F.coalesce(F.sum("_eh_bytes"), F.lit(0))).first()[0]
        split = max(1, left.count() if left is not None else 1)
        bits = min(DIRECTORY_BITS, 4 + math.ceil(math.log2(1 + total / limit / split)))
        bits = min(bits, (ID_BITS if start < ID_BITS else ALL_BITS) - start)
        entries = written(_directory(slim, start, bits, limit), "extendible")
        start += bits
        directories.append((start, entries.where("bucket is not null")))
        left = entries.where("bucket is null").select(F.col("cell").alias("_eh_open"))
        if not left.head(1):
            break
        if start == ID_BITS:  # one id holds more than a shard: row hashes must stay as they are
            rows = written(rows, "extendible")
            slim = rows.select("_eh_hash", "_eh_bytes")
        slim = written(slim.join(small_side(left), _prefix(start) == F.col("_eh_open"), "left_semi"), "extendible")
    out = rows
    for i, (bits, entries) in enumerate(directories):
        side = small_side(entries.select(F.col("cell").alias(f"_eh_cell{i}"), F.col("bucket").alias(f"_eh_bucket{i}")))
        out = out.join(side, _prefix(bits) == F.col(f"_eh_cell{i}"), "left")
    buckets = [f"_eh_bucket{i}" for i in range(len(directories))]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_eh_bytes", F.coalesce(*buckets).alias("_eh_bucket"))


def report(assigned: DataFrame, *more: str) -> DataFrame:
    return assigned.select(*more, F.col("_eh_bytes").alias("n_bytes"), F.col("_eh_bucket.shard").alias("shard"), F.col("_eh_bucket.depth").alias("depth"),
                           F.col("_eh_bucket.shard_bytes").alias("shard_bytes"), F.col("_eh_bucket.shard_docs").alias("shard_docs"))


_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits
           FROM documents),
p AS (SELECT doc_id, n_bytes, left(bits, depth) AS shard, CAST(depth AS INTEGER) AS depth
      FROM (SELECT *, unnest(range(0, 41)) AS depth FROM d)),
s AS (SELECT shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY shard)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, depth, shard_bytes, shard_docs
FROM (SELECT p.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
      FROM p JOIN s USING (shard) WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1)
WHERE k = 1
"""


@register("op4_extendible_sharding", _SQL)
def op4(spark, sf_dir):
    return report(assign(documents(spark, sf_dir).select("doc_id", "text")), "doc_id")
