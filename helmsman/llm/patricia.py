"""Exact dedup with Patricia-trie owners.

Every task first inserts its own texts into a compressed radix trie and emits
one row per distinct text with the ids it saw, so a text that fills a third of
the table reaches the next step once per task, not once per document.  Those
rows are partitioned by (length, content hash); each reducing task inserts the
full byte strings into its trie, whose terminal nodes store the owner (smallest
or largest id) and the group size.  Tries are bounded: when a trie holds more
than ``budget`` bytes it gives up its largest subtree, whose strings, and all
later ones below the same prefix, go to the next round unresolved.

Defined results: null texts count as empty; null ids count in ``group_size``
and never own unless the whole group has none (``keep_id`` is then null and all
its rows are kept); rows repeated with one id and text are one group and share
``kept``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import register
from .shared import documents, run_folder, slices, text_buffer

TRIE_BYTES = 128 << 20
LEAF_COST = 400  # bytes of Python objects that a terminal costs besides its label


class _Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.children, self.owner = label, {}, owner


class Patricia:
    """Compressed radix trie over byte strings; ``owner`` marks a terminal."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.held, self.budget = _Node(b""), 0, budget
        self.given_up: list[bytes] = []

    def insert(self, key: bytes, new: Callable[[], list]) -> list | None:
        """The terminal's owner of ``key`` (``new()`` when it is new), or None
        when its subtree has been given up."""
        if self.given_up and any(key.startswith(p) for p in self.given_up):
            return None
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.owner is None:
                    node.owner = new()
                    self.held += LEAF_COST
                return node.owner
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = _Node(key[at:], new())
                self.held += len(key) - at + LEAF_COST
                return leaf.owner
            label = child.label
            if not key.startswith(label, at):
                same = _common(label, key, at)
                upper = _Node(label[:same])
                child.label = label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.held += LEAF_COST
            node, at = child, at + len(child.label)

    def walk(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """All (string, owner) below ``node``."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node.owner
            stack += [(c, prefix + c.label) for c in node.children.values()]

    def give_up(self) -> list[tuple[bytes, list]]:
        """Detach the largest subtree one branch below the longest common
        prefix; returns its strings with their owners."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.owner is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        if not node.children:
            return []
        below = {k: sum(len(s) + LEAF_COST for s, _ in self.walk(c, c.label)) for k, c in node.children.items()}
        first = max(below, key=lambda k: (below[k], -k))
        child = node.children.pop(first)
        self.given_up.append(prefix + bytes([first]))
        self.held = max(0, self.held - below[first])
        return list(self.walk(child, prefix + child.label))


def _common(label: bytes, key: bytes, at: int) -> int:
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # longest common prefix by halving
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _better(a, b, largest: bool):
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


_LOCAL = "text binary, ids array<long>, best long, n long"
_OUT = "class string, ids array<long>, best long, n long, sha string, text binary, ref string"


def _local(largest: bool, budget: int):
    """Per task: one row per distinct text with its ids (flushed at the budget)."""
    schema = pa.schema([("text", pa.large_binary()), ("ids", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64())])

    def flush(trie):
        rows = list(trie.walk())
        for at in range(0, len(rows), 512):
            part = rows[at: at + 512]
            ids = [o[0] for _, o in part]
            best = [max((i for i in x if i is not None), default=None) if largest else min((i for i in x if i is not None), default=None) for x in ids]
            yield pa.record_batch([pa.array([k for k, _ in part], pa.large_binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], schema=schema)

    def run(batches):
        trie, seen = Patricia(), 0
        for batch in slices(batches, "text"):
            raw, off = text_buffer(batch.column(1))
            data, off = raw.tobytes(), off.tolist()
            for r, doc_id in enumerate(batch.column(0).to_pylist()):
                trie.insert(data[off[r]: off[r + 1]], lambda: [[]])[0].append(doc_id)
            seen += 16 * batch.num_rows
            if trie.held + seen > budget:
                yield from flush(trie)
                trie, seen = Patricia(), 0
        yield from flush(trie)

    return run


def _owners(budget: int, largest: bool, round_no: int):
    """Per reducing task: a member row (class, ids) for each incoming row, an
    owner row (class, best, n, sha) for each terminal, and unresolved rows
    (text, ...) of subtrees that were given up.  Member rows stream out at once;
    a terminal that is given up goes on as one row whose ``ref`` names the class
    its members already carry."""
    schema = pa.schema([("class", pa.string()), ("ids", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64()),
                        ("sha", pa.string()), ("text", pa.large_binary()), ("ref", pa.string())])

    def batch(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        trie, out, serial, size = Patricia(budget), [], 0, 0
        task = TaskContext.get().partitionId()

        def terminal():
            nonlocal serial
            serial += 1
            return [f"{round_no}.{task}.{serial}", None, 0]

        for part in batches:
            for text, ids, best, n, ref in zip(*(part.column(c) for c in ("text", "ids", "best", "n", "ref"))):
                text, ids, best, n, ref = text.as_py(), ids.as_py(), best.as_py(), n.as_py(), ref.as_py()
                owner = trie.insert(text, terminal)
                if owner is None:
                    out.append((None, ids, best, n, None, text, ref))
                    size += len(text)
                else:
                    owner[1], owner[2] = _better(owner[1], best, largest), owner[2] + n
                    out.append((owner[0], ids, None, None, None, None, ref))
                    if trie.held > budget:
                        for gone, (name, best, n) in trie.give_up():
                            out.append((None, None, best, n, None, gone, name))
                            size += len(gone)
                if len(out) >= 1024 or size > 8 << 20:
                    yield batch(out)
                    out, size = [], 0
        for text, (name, best, n) in trie.walk():
            out.append((name, None, best, n, hashlib.sha256(text).hexdigest(), None, None))
            if len(out) >= 1024:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def dedup(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names which id of a group stays, ``smallest`` or ``largest``."""
    spark, largest = docs.sparkSession, keep == "largest"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    todo = rows.mapInArrow(_local(largest, budget // 2), _LOCAL).withColumn("ref", F.lit(None).cast("string"))
    parts, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    folder = run_folder(spark, "patricia")
    while True:
        at = f"{folder}/{len(rounds)}"
        (todo.repartition(parts << len(rounds), F.length("text"), F.xxhash64("text"))
         .mapInArrow(_owners(budget, largest, len(rounds)), _OUT).write.parquet(at))
        rounds.append(spark.read.schema(_OUT).parquet(at))
        todo = rounds[-1].where("class is null").select("text", "ids", "best", "n", "ref")
        if not todo.head(1):
            break
    owner_columns = ["class", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256")]
    owners = members = None
    for found in reversed(rounds):  # a class given up in one round has the owner that a later round found
        own = found.where("sha is not null").select(*owner_columns)
        ids = found.where("class is not null and ids is not null").select("class", F.explode("ids").alias("doc_id"))
        if owners is None:
            owners, members = own, ids
            refs = found
        else:
            passed = refs.where("class is not null and ref is not null").select("class", "ref").join(owners, "class").drop("class").withColumnRenamed("ref", "class")
            owners, members, refs = owners.unionByName(own).unionByName(passed.select(*own.columns)), members.unionByName(ids), found
    return members.join(owners, "class").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@register("op7_patricia_exact_dedup", _SQL)
def op7(spark, sf_dir):
    return dedup(documents(spark, sf_dir), keep="largest")
