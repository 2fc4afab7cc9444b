"""Conversation prefix trie, encoded as balanced parentheses per shard.

Conversations are sequences of turns; every distinct prefix is a node, the empty
prefix the root.  A turn is 24 bytes: 16 of a digest of (role, text) and the length
of its text, so a conversation is one byte string and the trie is in depth-first
order when the strings are sorted.

1. Conversations are sorted by (sequence, id) over range partitions; ids are part of
   the key, so copies of one conversation spread over many tasks.
2. A task cuts its sorted stream into shards of ``SHARD`` nodes and conversations.  A shard's trie
   becomes a string of balanced parentheses with a running excess and, for blocks of
   ``BITS`` bits, the least and largest excess (range min-max blocks).  ``findclose``
   of a node scans its block, skips blocks that cannot hold the excess, and scans one
   more; it delimits the node's subtree.  Leaves of a subtree are the "()" pairs
   between the two parentheses (rank), its savings a difference of two cumulative
   sums over nodes in order.
3. Nodes on the path of a shard's first or last conversation (its spines) may go on
   in the neighbouring shard: they stay open, carrying what their closed subtrees
   add up to.  Everything else is finished.  Spines of neighbours are merged by the
   same code, first within a task, then ``FAN`` tasks at a time, until one is left.
4. Finished nodes whose parent was still open get its conversation by a join over the
   open nodes, whose number grows with the shards only; lists of conversations that
   end at an open node pass as one string per shard and are digested in order.

Memory: a task holds a shard, its spines and one conversation's sequence (24 bytes a
turn); no list of a node's members is collected.

Defined results: rows with a null conversation id belong to no conversation and are
left out; null turns come first; rows of one turn are taken in the order of their 24
bytes; null role or text is empty; repeated rows are turns of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmsman.session import sf_path

from .conversation_repair import runs
from .registry import register
from .shared import column_bytes, small_side, written

TURN = 24  # bytes of a turn: digest, length
SHARD = 1 << 15  # nodes and conversations of a shard
BITS = 256  # parentheses of a range min-max block
FAN = 256  # tasks whose spines are merged at a time
TASK_BYTES = 32 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


# --- balanced parentheses ----------------------------------------------------

class Parentheses:
    """The trie of nodes given by their depths in order, as parentheses."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        rise = np.diff(depth, prepend=depth[0] - 1)  # the root opens first; a node closes 1 - rise others before
        self.opens = np.arange(n) + np.cumsum(1 - rise)  # parentheses in front of each open one
        bits = np.zeros(2 * n, np.int8)
        bits[self.opens] = 1
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        self.rank = np.cumsum(bits, dtype=np.int64)
        pair = np.zeros(2 * n, np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.cumsum(pair)
        starts = np.arange(0, 2 * n, BITS)
        self.low, self.high = np.minimum.reduceat(self.excess, starts), np.maximum.reduceat(self.excess, starts)

    def findclose(self, at: int) -> int:
        """Index of the parenthesis that closes the one at ``at``."""
        want, block = int(self.excess[at]) - 1, at // BITS
        end = (block + 1) * BITS
        hit = np.flatnonzero(self.excess[at + 1: end] == want)
        if len(hit):
            return at + 1 + int(hit[0])
        block += 1
        while not self.low[block] <= want <= self.high[block]:
            block += 1
        return block * BITS + int(np.flatnonzero(self.excess[block * BITS: (block + 1) * BITS] == want)[0])

    def leaves(self, first: np.ndarray, close: np.ndarray) -> np.ndarray:
        """"()" pairs between parentheses ``first`` and ``close``."""
        return self.pairs[close] - np.where(first > 0, self.pairs[first - 1], 0)


# --- a shard -----------------------------------------------------------------

class Trie:
    """Nodes in depth-first order with what is known of each."""

    def __init__(self):
        self.depth, self.turn, self.n, self.least, self.kids, self.leaves, self.saved, self.parent = ([] for _ in range(8))
        self.ends: dict[int, list[str]] = {}
        self.members = 0
        self.path: list[int] = []  # nodes of the last conversation, the root first

    def child(self, depth: int, turn: bytes) -> int:
        """The node ``turn`` at ``depth`` on the current path, made if it is new."""
        if depth < len(self.path) and self.turn[self.path[depth]] == turn:
            return self.path[depth]
        del self.path[depth:]
        node = len(self.depth)
        self.parent.append(self.path[-1] if self.path else -1)
        self.path.append(node)
        self.depth.append(depth)
        self.turn.append(turn)
        self.n.append(0)
        self.least.append(None)
        for column in (self.kids, self.leaves, self.saved):
            column.append(0)
        return node

    def add(self, node: int, n: int, least: int, kids: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n[node] += n
        self.least[node] = least if self.least[node] is None else min(self.least[node], least)
        self.kids[node] += kids
        self.leaves[node] += leaves
        self.saved[node] += saved

    def conversation(self, sequence: bytes, conv: int) -> None:
        for depth in range(len(sequence) // TURN + 1):
            node = self.child(depth, sequence[(depth - 1) * TURN: depth * TURN] if depth else b"")
            self.add(node, 1, conv)
        del self.path[depth + 1:]
        self.ends.setdefault(node, []).append(str(conv))
        self.members += 1

    def merge(self, spine: bytes) -> None:
        """Another trie's open nodes, which come after all of this one's."""
        for depth, turn, *known in unpack(spine):
            node = self.child(depth, turn)
            self.add(node, *known)
        # the last open node in order is on the last conversation's path
        del self.path[depth + 1:]


_NODE = struct.Struct("<q24s?qqqqq")  # depth, turn, whether it has one, n, least, kids, leaves, saved


def unpack(spine: bytes):
    for depth, turn, has, *known in _NODE.iter_unpack(spine):
        yield depth, turn if has else b"", *known


_ROW = pa.schema([("spine", pa.binary()), ("task", pa.int64()), ("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                  ("ends_sha256", pa.string()), ("ends", pa.string()), ("first_end", pa.int64())])
_ROW_SQL = ("spine binary, task long, key binary, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, "
            "n_leaves long, saved_tokens long, ends_sha256 string, ends string, first_end long")


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ROW], schema=_ROW)


def closed(trie: Trie, first_path: list[int], open_keys: bool, everything: bool) -> tuple[list[dict], bytes]:
    """(finished rows and end lists of open nodes, the open nodes).  ``open_keys``:
    the nodes come from spines, so each may be the parent of finished ones and is
    named by its key."""
    depth = np.array(trie.depth, np.int64)
    encoded = Parentheses(depth)
    close = np.array([encoded.findclose(at) for at in encoded.opens.tolist()], np.int64)
    last = encoded.rank[close]  # nodes up to the end of the subtree
    size = np.array([struct.unpack(">q", t[16:])[0] if t else 0 for t in trie.turn], np.int64)
    n, kids = np.array(trie.n, np.int64), np.array(trie.kids, np.int64)
    parent = np.array(trie.parent, np.int64)
    children = kids + np.bincount(parent[parent >= 0], minlength=len(n))
    is_open = np.zeros(len(n), bool)
    if not everything:
        is_open[first_path] = is_open[trie.path] = True
    # A pair "()" is a leaf unless the node has closed children in other shards; open
    # nodes count nothing of their own yet.
    pair = encoded.bits[encoded.opens + 1] == 0
    not_leaf = np.concatenate([[0], np.cumsum(pair & ((kids > 0) | is_open))])
    carried = np.concatenate([[0], np.cumsum(np.array(trie.leaves, np.int64))])
    own = np.where(is_open, 0, (n - 1) * size) + np.array(trie.saved, np.int64)
    saving = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(len(n))
    leaves = encoded.leaves(encoded.opens, close) - (not_leaf[last] - not_leaf[at]) + carried[last] - carried[at]
    saved = saving[last] - saving[at]
    paths = keys(trie, is_open if not open_keys else np.ones(len(n), bool))
    out = []
    for i in np.flatnonzero(~is_open).tolist():
        up = int(parent[i])
        row = {"key": paths.get(i) if open_keys else None, "conv_id": trie.least[i], "depth": int(depth[i]), "n_convs": int(n[i]), "n_children": int(children[i]),
               "n_leaves": int(leaves[i]), "saved_tokens": int(saved[i])}
        if not open_keys:
            row["ends_sha256"] = hashlib.sha256(",".join(trie.ends[i]).encode()).hexdigest() if i in trie.ends else EMPTY
        if up >= 0 and is_open[up]:
            row["parent_key"] = paths[up]
        elif up >= 0:
            row["parent_conv_id"] = trie.least[up]
        out.append(row)
    for i in trie.ends:
        if is_open[i]:
            out.append({"key": paths[i], "ends": ",".join(trie.ends[i]), "first_end": int(trie.ends[i][0])})
    spine = bytearray()
    hangs = np.flatnonzero(~is_open & (parent >= 0) & is_open[np.maximum(parent, 0)])
    more = [np.array(c, np.int64) for c in (trie.kids, trie.leaves, trie.saved)]
    for column, value in zip(more, (1, leaves, saved)):
        np.add.at(column, parent[hangs], value if isinstance(value, int) else value[hangs])
    for i in np.flatnonzero(is_open).tolist():
        spine += _NODE.pack(trie.depth[i], trie.turn[i], bool(trie.turn[i]), trie.n[i], trie.least[i], *(int(c[i]) for c in more))
    return out, bytes(spine)


def keys(trie: Trie, wanted: np.ndarray) -> dict[int, bytes]:
    """16 bytes that name the path of each wanted node (whose parents are wanted too)."""
    hashes, out = {}, {}
    for i in np.flatnonzero(wanted).tolist():
        made = hashes[trie.parent[i]].copy() if trie.parent[i] >= 0 else hashlib.sha256()
        made.update(trie.turn[i])
        hashes[i], out[i] = made, made.digest()[:16]
    return out


def _sequence_task(batches):
    """Rows (conv_id, turn bytes) in order -> (conv_id, sequence)."""
    now, parts, out, size = None, [], [], 0

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["conv_id", "sequence"])

    for key, new, rows in runs(batches, "conv_id"):
        if new and now is not None:
            out.append((now, b"".join(parts)))
            size += len(out[-1][1])
            parts = []
            if size > 1 << 20:
                yield emit()
                out, size = [], 0
        now = key
        parts.extend(rows.column(1).to_pylist())
    if now is not None:
        out.append((now, b"".join(parts)))
    yield emit()


def _shard_task(limit: int):
    """Sorted (sequence, conv_id) -> finished rows of the task's shards and one row
    of its open nodes."""

    def run(batches):
        from pyspark import TaskContext

        task, spines = TaskContext.get().partitionId(), []
        trie, first = Trie(), None

        def finish():
            rows, spine = closed(trie, first, open_keys=False, everything=False)
            spines.append(spine)
            return rows

        for batch in batches:
            for sequence, conv in zip(batch.column(0), batch.column(1).to_pylist()):
                trie.conversation(sequence.as_py(), conv)
                if first is None:
                    first = list(trie.path)
                if len(trie.depth) + trie.members >= limit:
                    yield _rows(finish())
                    trie, first = Trie(), None
                    if len(spines) > 64:
                        rows, spine = merged(spines)
                        spines[:] = [spine]
                        yield _rows(rows)
        if first is not None:
            yield _rows(finish())
        if spines:
            rows, spine = merged(spines) if len(spines) > 1 else ([], spines[0])
            yield _rows([*rows, {"spine": spine, "task": task}])

    return run


def merged(spines: list[bytes], everything: bool = False) -> tuple[list[dict], bytes]:
    """Finished rows of the merged open nodes of neighbouring shards, and what stays open."""
    trie, first = Trie(), None
    for spine in spines:
        trie.merge(spine)
        if first is None:
            first = first_path(trie)
    return closed(trie, first, open_keys=True, everything=everything)


def first_path(trie: Trie) -> list[int]:
    """The path of the first conversation: each next node is one deeper."""
    out = [0]
    while out[-1] + 1 < len(trie.depth) and trie.depth[out[-1] + 1] == trie.depth[out[-1]] + 1:
        out.append(out[-1] + 1)
    return out


def _merge_task(everything: bool):
    """Rows (group, task, spine) in order -> finished rows and one row a group."""

    def run(batches):
        now, spines = None, []

        def finish():
            rows, spine = merged(spines, everything)
            return _rows(rows if everything else [*rows, {"spine": spine, "task": now}])

        for batch in batches:
            for group, spine in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if group != now and spines:
                    yield finish()
                    spines = []
                now = group
                spines.append(spine)
        if spines:
            yield finish()

    return run


def _ends_task(batches):
    """Rows (key, first_end, ends) in order -> (key, sha): one digest a key."""
    now, sha, out = None, None, []
    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ends.encode())
            else:
                sha.update(("," + ends).encode())
    if now is not None:
        out.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["end_key", "sha"])


# --- the operator ------------------------------------------------------------

def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, sequence) of every conversation, its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turn = F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn.alias("bytes")).where("conv_id is not null")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "bytes")
    return ordered.select("conv_id", "bytes").mapInArrow(_sequence_task, "conv_id long, sequence binary")


def trie(found: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of ``found`` (conv_id, sequence): conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    spark = found.sparkSession
    found = written(found, "trie")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-column_bytes(found, "sequence") // TASK_BYTES))
    ordered = found.select("sequence", "conv_id").repartitionByRange(parts, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    levels = [written(ordered.mapInArrow(_shard_task(shard), _ROW_SQL), "trie")]
    while True:
        spines = levels[-1].where("task is not null").select(F.floor(F.col("task") / fan).cast("long").alias("group"), "task", "spine")
        top = spines.agg(F.max("group")).first()[0]
        if top is None:
            break
        dealt = spines.repartition("group").sortWithinPartitions("group", "task")
        levels.append(written(dealt.mapInArrow(_merge_task(top == 0), _ROW_SQL), "trie"))
        if top == 0:
            break
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    nodes = rows.where("depth is not null")
    names = written(nodes.where("key is not null").select(F.col("key").alias("up_key"), F.col("conv_id").alias("up")), "trie")
    ends = rows.where("ends is not null").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
    ends = written(ends.mapInArrow(_ends_task, "end_key binary, sha string"), "trie")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("key is null and parent_key is null").select(*out)
    outer = (nodes.where("key is not null or parent_key is not null")
             .join(small_side(names), F.col("parent_key") == F.col("up_key"), "left")
             .join(small_side(ends), F.col("key") == F.col("end_key"), "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
             .withColumn("ends_sha256", F.coalesce("ends_sha256", "sha", F.lit(EMPTY))))
    return inner.unionByName(outer.select(*out))


# --- the query ---------------------------------------------------------------

HEAD = 8  # turns that a rebuilt conversation may borrow at most


def rebuilt(found: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 5 in place
    of its own first h, h = crc32(c) % 9."""
    heads = found.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.substring("sequence", 1, HEAD * TURN).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD + 1)).cast("int")
    joined = found.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    nothing = F.lit("").cast("binary")
    return joined.select("conv_id", F.concat(F.coalesce(F.expr(f"substring(head, 1, h * {TURN})"), nothing), F.expr(f"substring(sequence, h * {TURN} + 1)")).alias("sequence"))


_ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
        list_concat([n::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tb),
ids AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT],
            list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
            lambda a, b: xor(tb[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(role)::VARCHAR || ':' || role || text), 32)) AS p FROM src),
turns AS (SELECT ids.conv_id, p, role, text FROM ids JOIN own ON own.conv_id = ids.conv_id - ids.conv_id % 5 AND p <= h
    UNION ALL SELECT ids.conv_id, p, role, text FROM ids JOIN own ON own.conv_id = ids.conv_id AND p > h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, strlen(text) AS bytes,
        sha256(length(role)::VARCHAR || ':' || role || text) AS t FROM turns),
pre AS (SELECT conv_id, depth, bytes, sha256(string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM seq
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
len AS (SELECT conv_id, max(depth) AS len FROM pre GROUP BY conv_id),
node AS (SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM pre GROUP BY prefix),
up AS (SELECT node.*, p.prefix AS parent FROM node LEFT JOIN pre p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1),
kids AS (SELECT parent AS prefix, count(*) AS n FROM up GROUP BY parent),
below AS (SELECT anc.prefix, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.bytes) AS saved
    FROM node JOIN pre anc ON anc.conv_id = node.conv_id AND anc.depth <= node.depth LEFT JOIN kids ON kids.prefix = node.prefix GROUP BY anc.prefix),
fin AS (SELECT pre.prefix, sha256(string_agg(pre.conv_id::VARCHAR, ',' ORDER BY pre.conv_id)) AS h FROM pre JOIN len ON len.conv_id = pre.conv_id AND len.len = pre.depth GROUP BY pre.prefix)
SELECT up.conv_id, up.depth::BIGINT AS depth, pn.conv_id AS parent_conv_id, up.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
    below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(fin.h, sha256('')) AS ends_sha256
FROM up LEFT JOIN node pn ON pn.prefix = up.parent LEFT JOIN kids ON kids.prefix = up.prefix
JOIN below ON below.prefix = up.prefix LEFT JOIN fin ON fin.prefix = up.prefix
"""


@register("op13_prefix_trie", _ORACLE)
def op13(spark, sf_dir):
    found = written(sequences(spark.read.parquet(sf_path(sf_dir, "conversations"))), "trie")
    return trie(rebuilt(found))
