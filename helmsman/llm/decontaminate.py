"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the benchmark's windows of ``WINDOW`` consecutive words (a
shorter item is one window), written with one zero byte before, between and
after the words.  Patterns are split into classes by length; each class has a
shift table over blocks of up to eight bytes, suffix-hash buckets for blocks
that end a pattern's first ``m`` bytes, and a direct comparison.  A task runs
many cursors over its slice of text at once (numpy), each jumping by the shift
of the block under it.

The benchmark is the stated pattern set: it goes out in blocks of at most
``BLOCK_BYTES`` bytes, each block one narrow pass over the documents without a
shuffle.  Passes are cut by written tables, so a task holds one block at a time.

Defined results: null or wordless texts have no words and no hits; null or
wordless items give no pattern; rows of one item_id are one item, a null
item_id is an item written as the empty string; repeated documents are reported
once per row; other columns pass through ``scan`` untouched (its own columns
start with ``_wm_``).
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmsman.session import sf_path

from .registry import register
from .shared import ALNUM, U64, documents, slices, text_buffer, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def canonical(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, bounds): all rows as ``0 word 0 word 0 1`` bytes, where each
    word starts, and row r's words bounds[r]:bounds[r+1]."""
    n = len(off) - 1
    buf = np.insert(ALNUM[raw], np.repeat(off[1:], 3), np.tile(np.array([0, 1, 0], np.uint8), n))
    buf = np.concatenate([np.zeros(1, np.uint8), buf])
    inside = buf > 1
    edge = np.diff(inside.view(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    row_at = off + 3 * np.arange(n + 1) + 1
    keep = inside
    keep[np.flatnonzero(edge == -1)] = True
    keep[row_at[1:] - 2] = True
    keep[row_at - 1] = True
    place = np.cumsum(keep) - 1
    return buf[keep], place[starts], np.searchsorted(starts, row_at)


def windows(items: list[tuple[str, str]], width: int = WINDOW) -> dict[bytes, set[str]]:
    """Pattern bytes -> ids of the items that have it."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = bytes(ALNUM[np.frombuffer((text or "").encode(), np.uint8)]).split(b"\0")
        words = [w for w in words if w]
        for at in range(max(1, len(words) - width + 1) if words else 0):
            out[b"\0" + b"\0".join(words[at: at + width]) + b"\0"].add(item or "")
    return out


class WuManber:
    """Shift table and suffix-hash buckets of patterns of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = min(8, m, max(2, m // 2 + 1))
        self.drop = U64(64 - 8 * block)
        self.shift = np.full(1 << _TABLE_BITS, m - block + 1, np.int64)
        heads = np.zeros((len(patterns), 8 + m), np.uint8)
        for i, p in enumerate(patterns):
            heads[i, 8:] = np.frombuffer(p[:m], np.uint8)
        ends = []
        for end in range(block - 1, m):  # index of the block's last byte
            word = np.ascontiguousarray(heads[:, end + 1: end + 9]).view("<u8").ravel()
            slot = self.slots(word)
            np.minimum.at(self.shift, slot, m - 1 - end)
            ends = slot
        order = np.argsort(ends, kind="stable")
        self.suffix, self.members = ends[order], order

    def slots(self, words: np.ndarray) -> np.ndarray:
        return (((words >> self.drop) * _MULTIPLIER) >> U64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, padded: np.ndarray, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence; ``padded`` is ``data`` after 8 zero bytes."""
        n = len(data)
        if n < self.m:
            return []
        words = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        lane = 512
        at = np.arange(self.m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        found_at, found_slot = [], []
        while len(at):
            slot = self.slots(words[at + 1])  # the eight bytes that end at ``at``
            jump = self.shift[slot]
            hit = jump == 0
            if hit.any():
                found_at.append(at[hit])
                found_slot.append(slot[hit])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found_at:
            return []
        ends, slot = np.concatenate(found_at), np.concatenate(found_slot)
        low, high = np.searchsorted(self.suffix, slot, "left"), np.searchsorted(self.suffix, slot, "right")
        out = []
        for end, a, b in zip(ends.tolist(), low.tolist(), high.tolist()):
            start = end - self.m + 1
            out += [(start, int(p)) for p in self.members[a:b] if data.startswith(self.patterns[p], start)]
        return out


class Searcher:
    """All patterns of a block, in classes of similar length."""

    def __init__(self, items: list[tuple[str, str]]):
        by_class: dict[int, list[bytes]] = defaultdict(list)
        self.items = windows(items)
        for p in self.items:
            by_class[min(len(p).bit_length(), 6)].append(p)  # one class from 32 bytes on
        self.classes = [WuManber(sorted(ps)) for _, ps in sorted(by_class.items())]

    def search(self, text: np.ndarray) -> list[tuple[int, bytes]]:
        padded, data = np.concatenate([np.zeros(8, np.uint8), text]), text.tobytes()
        return [(at, c.patterns[p]) for c in self.classes for at, p in c.search(padded, data)]


_searchers: dict[str, Searcher] = {}

_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_RESULT = [T.StructField("_wm_words", T.LongType()), T.StructField("_wm_spans", _SPANS), T.StructField("_wm_items", T.ArrayType(T.StringType()))]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _pass(block, key: str):
    def run(batches):
        if key not in _searchers:
            _searchers.clear()
            _searchers[key] = Searcher(block.value)
        searcher = _searchers[key]
        for batch in slices(batches, "text"):
            raw, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            text, starts, bounds = canonical(raw, off)
            old = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_wm_spans", "_wm_items")}
            spans = [[(s["first"], s["end"]) for s in x] for x in old["_wm_spans"]]
            items = [set(x) for x in old["_wm_items"]]
            touched = set()
            found = searcher.search(text)
            first = np.searchsorted(starts, [at + 1 for at, _ in found])
            rows = np.searchsorted(bounds, first, "right") - 1
            for (_, pattern), word, row in zip(found, first.tolist(), rows.tolist()):
                at = word - int(bounds[row])
                spans[row].append((at, at + pattern.count(b"\0") - 1))
                items[row] |= searcher.items[pattern]
                touched.add(row)
            for row in touched:
                spans[row] = _merge(spans[row])
            keep = [i for i, n in enumerate(batch.schema.names) if not n.startswith("_wm_")]
            columns = [batch.column(i) for i in keep] + [
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], _ARROW_SPANS),
                pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + [f.name for f in _RESULT])

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The benchmark's (item_id, text) in blocks of bounded bytes."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += 4 * len(text)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _wm_words (number of words), _wm_spans (merged word ranges
    hit by benchmark windows) and _wm_items (ids of the items found)."""
    sc = docs.sparkSession.sparkContext
    out = docs.withColumns({
        "_wm_words": F.lit(0).cast("long"),
        "_wm_spans": F.array().cast("array<struct<first:bigint,end:bigint>>"),
        "_wm_items": F.array().cast("array<string>"),
    })
    schema = T.StructType([*docs.schema.fields, *_RESULT])
    for i, block in enumerate(blocks(benchmark, limit)):
        out = written(out, "decontaminate") if i else out
        out = out.mapInArrow(_pass(sc.broadcast(block), uuid.uuid4().hex), schema)
    return out


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, p.n, item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``, one row per document."""
    hit = F.aggregate("_wm_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    items = F.array_join("_wm_items", ",")
    return scanned.select("doc_id", F.col("_wm_words").alias("n_words"), hit.alias("n_hit"),
                          F.size("_wm_items").cast("long").alias("n_items"),
                          F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@register("op3_wu_manber_decontamination", _SQL)
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return report(scan(docs, spark.read.parquet(sf_path(sf_dir, "benchmark"))))
