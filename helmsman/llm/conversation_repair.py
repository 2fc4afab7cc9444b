"""Conversation structure repair by Four-Russians block tables.

A conversation is valid when the initials of its roles read ``(s?(ua)+)?``.  The
edits are Keep (0), Rerole to user or assistant (3), Delete (4, the only edit of a
blank or duplicate row) and Insert an empty user or assistant turn (3); a
truncated row that stays adds 3.  The repair is the cheapest edit list, ties going
to the ASCII-least string of edit initials.

The automaton of valid conversations has four states (start, after s, after u,
after a), so the cost to finish from each state is a vector of four numbers, and
less its minimum only a few dozen vectors exist.  A row is one of nine symbols (role
initial, truncated or not; or must go).  The tables hold, for each block of
``BLOCK`` symbols and each normalised vector after it, the vector before it and
what the minimum grows by.  A conversation is read from its end, a block per
lookup.  Its edits are traced from its front: each block is expanded backward from
the vector stored at its right end, and from the state at its left end the least
initial that still reaches the minimum is taken.  Every initial leads to one state
only, so this gives the least string among all cheapest ones.

On Spark: rows are judged by column expressions (duplicates by a window over
(conversation, role, text)), narrow rows go once to their conversation in turn
order, one byte a row is kept, and the finished edits then meet the whole rows as a
sorted stream, one row at a time.  The task of a conversation holds one byte a row,
as its audit does in the result; its texts are never collected.

Defined results: null roles and texts are one space (such a text is blank, such a
role fits nowhere); an empty role or one of another initial fits nowhere either; a
null conversation id is a conversation; null turns come first; rows of one turn are
taken in the order of a digest of (role, text), so repeated rows are adjacent; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmsman.session import sf_path

from .registry import register

BLOCK = 4
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 3, 3, 4, 3
GAPS = " \t\n\x0b\x0c\r"
_TO = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
_MUST_GO, _NOTHING = 8, 9  # symbols beside class + 4 * truncated; _NOTHING fills a block
_FAR = 10_000


def _step(initial: str, state: int) -> int | None:
    return _TO.get((initial, state))


def _added(state: int) -> int:
    """The state after the only turn that may be inserted (or reroled) there."""
    return 3 if state == 2 else 2


def _inserted(costs: list[int]) -> list[int]:
    """Costs once any turns may be inserted before the next row."""
    out = list(costs)
    out[2], out[3] = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    out[0], out[1] = min(costs[0], INSERT + out[2]), min(costs[1], INSERT + out[2])
    return out


END = tuple(_inserted([0, _FAR, _FAR, 0]))  # a conversation may end at the start or after an assistant


def before(symbol: int, after: list[int] | tuple) -> list[int]:
    """Costs to finish before a row of ``symbol``, from those after it."""
    if symbol == _NOTHING:
        return list(after)
    out = [DELETE + c for c in after]
    if symbol != _MUST_GO:
        extra, initial = (TRUNCATED if symbol >= 4 else 0), "sua?"[symbol % 4]
        for q in range(4):
            out[q] = min(out[q], REROLE + extra + after[_added(q)])
            if (to := _step(initial, q)) is not None:
                out[q] = min(out[q], KEEP + extra + after[to])
    return _inserted(out)


@lru_cache(1)
def tables() -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(normalised vectors, next[block, vector], growth[block, vector]).  A block is
    its symbols as digits, the first one the most significant."""
    vectors, index, one = [END], {END: 0}, []
    at = 0
    while at < len(vectors):
        row = []
        for symbol in range(10):
            costs = before(symbol, vectors[at])
            low = min(costs)
            key = tuple(c - low for c in costs)
            if key not in index:
                index[key] = len(vectors)
                vectors.append(key)
            row.append((index[key], low))
        one.append(row)
        at += 1
    step = np.array(one, np.int32).transpose(2, 1, 0)  # [to or growth, symbol, vector]
    to, growth = step[0], step[1]
    for _ in range(BLOCK - 1):  # one more symbol in front of each block
        to, growth = step[0][:, to], growth[None] + step[1][:, to]
        to, growth = to.reshape(-1, len(vectors)), growth.reshape(-1, len(vectors))
    return vectors, to, growth


@lru_cache(1 << 16)
def expanded(block: int, vector: int, state: int) -> tuple[str, int]:
    """Edits of a block and the state after it, from the vector at its right end
    and the state at its left end."""
    symbols = [block // 10 ** (BLOCK - 1 - i) % 10 for i in range(BLOCK)]
    costs = [list(tables()[0][vector])]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    out = []
    for i, symbol in enumerate(symbols):
        if symbol == _NOTHING:
            continue
        while True:
            here, then = costs[i][state], costs[i + 1]
            extra = TRUNCATED if 4 <= symbol < 8 else 0
            kept = None if symbol == _MUST_GO else _step("sua?"[symbol % 4], state)
            if here == DELETE + then[state]:
                out.append("D")
            elif here == INSERT + costs[i][_added(state)]:
                out.append("I")
                state = _added(state)
                continue
            elif kept is not None and here == KEEP + extra + then[kept]:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = _added(state)
            break
    return "".join(out), state


def edits(symbols: np.ndarray) -> tuple[int, str]:
    """(cost, edit initials) of a conversation of 0..8 symbols."""
    _, to, growth = tables()
    fill = -len(symbols) % BLOCK
    digits = np.concatenate([np.full(fill, _NOTHING, np.int64), symbols.astype(np.int64)]).reshape(-1, BLOCK)
    blocks = (digits @ (10 ** np.arange(BLOCK - 1, -1, -1))).tolist()
    vector, cost, right = 0, 0, []
    for block in reversed(blocks):
        right.append(vector)
        cost += int(growth[block, vector])
        vector = int(to[block, vector])
    cost += tables()[0][vector][0]
    state, out = 0, []
    for block, vector in zip(blocks, reversed(right)):
        some, state = expanded(block, vector, state)
        out.append(some)
    while state not in (0, 3):
        out.append("I")
        state = _added(state)
    return cost, "".join(out)


# --- rows of a sorted stream -------------------------------------------------

def runs(batches, name: str):
    """(key, whether it starts, rows) of the runs of equal ``name`` in a sorted stream."""
    last, any_yet = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(name))
        nulls, values = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = None if nulls[a] else int(values[a])
            yield key, not any_yet or key != last, batch.slice(a, b - a)
            last, any_yet = key, True


_AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDIT_SQL = "conv_id long, " + ", ".join(f"{c} long" for c in _AUDIT) + ", audit string"


class _Open:
    """What is kept of the conversation that is being read: one byte a row."""

    def __init__(self, key):
        self.key, self.codes, self.low, self.high, self.distinct = key, bytearray(), None, None, 0

    def add(self, rows):
        code, turn = rows.column(rows.schema.names.index("code")).to_numpy(), rows.column(rows.schema.names.index("turn"))
        there = code < 16
        self.codes += code[there].astype(np.uint8).tobytes()
        known = turn.filter(pa.array(there)).drop_null().to_numpy()
        if len(known):  # turns come in order
            first = self.high is None or int(known[0]) != self.high
            self.distinct += int(first) + int((known[1:] != known[:-1]).sum())
            self.low = int(known[0]) if self.low is None else self.low
            self.high = int(known[-1])

    def row(self):
        code = np.frombuffer(bytes(self.codes), np.uint8)
        role, fault = code % 4, code // 4
        pair = role[:-1] * 4 + role[1:]
        legal = (pair == 1) | (pair == 6) | (pair == 9)  # su, ua, au
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        cost, audit = edits(np.where(fault >= 2, _MUST_GO, code))
        return (self.key, gaps, *(int((fault == f).sum()) for f in (2, 3, 1)), int((~legal).sum()), cost, audit)


def _audit_batch(rows):
    kinds = [pa.int64()] * 7 + [pa.string()]
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", *_AUDIT, "audit"])


def _audit_task(batches):
    """Rows (conv_id, turn, code) in order -> one row per conversation."""
    now, out = None, []
    for key, new, rows in runs(batches, "conv_id"):
        if new:
            if now is not None:
                out.append(now.row())
            now = _Open(key)
        now.add(rows)
        if len(out) >= 1024:
            yield _audit_batch(out)
            out = []
    if now is not None:
        out.append(now.row())
    yield _audit_batch(out)


# --- the operator ------------------------------------------------------------

def _clean(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present, digest) with nulls as one space."""
    names = {c.lower() for c in rows.columns}
    present = F.col("present") if "present" in names else F.lit(True)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), present.alias("present"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _class() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, the faults, the cost and its edits.  A row
    whose ``present`` (if there is such a column) is false only names its conversation."""
    rows = _clean(rows)
    end = F.rtrim("text", F.lit(GAPS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "digest").orderBy("turn"))
    narrow = rows.select("conv_id", "turn", "digest", "present", _class().alias("class"), (F.length(end) == 0).alias("blank"),
                         (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    narrow = narrow.withColumn("seen", seen)
    fault = F.when(F.col("blank"), 2).when(F.col("seen") > 1, 3).when(F.col("cut"), 1).otherwise(0)
    coded = narrow.select("conv_id", "turn", "digest", F.when(F.col("present"), F.col("class") + 4 * fault).otherwise(99).cast("int").alias("code"))
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "code")
    return ordered.select("conv_id", "turn", "code").mapInArrow(_audit_task, _AUDIT_SQL)


_REPAIRED = "conv_id long, pos long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in _AUDIT) + ", audit string"


def _apply_task(batches):
    """A conversation's audit, then its rows in order -> the audit (pos 0) and the
    edited rows (pos 1...; deleted rows have a null role)."""
    state = {"at": 0, "q": 0, "pos": 0, "audit": ""}

    def insert(out, key):
        out.append((key, state["pos"] + 1, "I", "assistant" if state["q"] == 2 else "user", ""))
        state.update(pos=state["pos"] + 1, at=state["at"] + 1, q=_added(state["q"]))

    def emit(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        rows = [(*r, *[None] * 7) if len(r) == 5 else r for r in out]
        columns = list(zip(*rows)) or [()] * 12
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "pos", "edit", "role", "text", *_AUDIT, "audit"])

    def finish(out, key):
        while state["at"] < len(state["audit"]):
            insert(out, key)

    last, out, size = None, [], 0
    for key, new, rows in runs(batches, "conv_id"):
        if new:
            finish(out, last)
        last = key
        columns = [rows.column(i).to_pylist() for i in range(1, rows.num_columns)]
        for side, present, role, text, *audit in zip(*columns):
            if side == 0:
                state.update(at=0, q=0, pos=0, audit=audit[-1])
                out.append((key, 0, None, None, None, *audit))
            elif present:
                while state["audit"][state["at"]] == "I":
                    insert(out, key)
                edit, q = state["audit"][state["at"]], state["q"]
                if edit == "K":
                    state["q"] = _step(role[0], q)
                elif edit == "R":
                    role, state["q"] = ("assistant" if q == 2 else "user"), _added(q)
                else:
                    role = None
                out.append((key, state["pos"] + 1, edit, role, text))
                state.update(pos=state["pos"] + 1, at=state["at"] + 1)
                size += len(text)
            if len(out) >= 4096 or size > 1 << 20:
                yield emit(out)
                out, size = [], 0
    finish(out, last)
    yield emit(out)


def repaired(rows: DataFrame) -> DataFrame:
    """Each conversation's audit as its row of pos 0 (columns gaps ... audit), then
    its edits in order (pos, edit, role, text), conversations never split over
    partitions.  A deleted row has its text and a null role."""
    found = audits(rows).select("conv_id", F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("present"),
                                F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_AUDIT, "audit",
                                F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    whole = _clean(rows).select("conv_id", F.lit(1).alias("side"), "present", "role", "text",
                                *[F.lit(None).cast("long").alias(c) for c in _AUDIT], F.lit(None).cast("string").alias("audit"), "turn", "digest")
    stream = found.unionByName(whole.where("present")).repartition("conv_id").sortWithinPartitions("conv_id", "side", F.col("turn").asc_nulls_first(), "digest")
    return stream.drop("turn", "digest").mapInArrow(_apply_task, _REPAIRED)


def _digest_task(batches):
    """The stream of ``repaired`` -> per conversation the audit and the SHA-256 of
    its repaired rows."""
    out, sha, some = [], None, False

    def emit(rows):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        columns = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", *_AUDIT, "audit", "repaired_sha256"])

    for batch in batches:
        head = batch.to_pydict()
        for i, (key, pos, role, text) in enumerate(zip(head["conv_id"], head["pos"], head["role"], head["text"])):
            if pos == 0:
                if sha is not None:
                    out[-1] = (*out[-1], sha.hexdigest())
                if len(out) >= 1024:
                    yield emit(out)
                    out = []
                out.append((key, *(head[c][i] for c in _AUDIT), head["audit"][i]))
                sha, some = hashlib.sha256(), False
            elif role is not None:
                sha.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                some = True
    if sha is not None:
        out[-1] = (*out[-1], sha.hexdigest())
    yield emit(out)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: its audit and the digest of its repaired rows."""
    return repaired(rows).mapInArrow(_digest_task, _AUDIT_SQL + ", repaired_sha256 string")


# --- the query ---------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """The conversations with planted faults: by crc32(conv_id:turn) % 20 a row is
    dropped (``present`` false), emptied, stripped of end marks, repeated or made a
    user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


_ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
        list_concat([n::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tb),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT src.*, xor(list_reduce(list_concat([4294967295::BIGINT],
            list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
            lambda a, b: xor(tb[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS kind FROM src, crc),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
keyed AS (SELECT *, unhex(sha256(length(role)::VARCHAR || ':' || role || text)) AS digest,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
        CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE '?' END AS ini FROM dmg),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS p,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM keyed),
judged AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY p) || ini AS pair FROM pos),
conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list([ini || fault] ORDER BY p) AS syms, list(role ORDER BY p) AS roles, list(text ORDER BY p) AS texts FROM judged GROUP BY conv_id),
-- each state's cheapest "cost|edits" so far: start, after s, after u, after a
run AS (SELECT *, list_reduce(list_concat([['000000|', NULL, '000003|I', '000006|II']], syms), lambda a, x:
    list_transform([list_transform([1, 2, 3, 4], lambda q: least(
        printf('%06d', left(a[q], 6)::INT + 4) || substr(a[q], 7) || 'D',
        CASE WHEN x[1][2:2] IN ('o', 't') THEN
            CASE q WHEN 2 THEN CASE WHEN x[1][1:1] = 's' THEN printf('%06d', left(a[1], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 3 ELSE 0 END) || substr(a[1], 7) || 'K' END
                   WHEN 3 THEN least(CASE WHEN x[1][1:1] = 'u' THEN least(
                            printf('%06d', left(a[1], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 3 ELSE 0 END) || substr(a[1], 7) || 'K',
                            printf('%06d', left(a[2], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 3 ELSE 0 END) || substr(a[2], 7) || 'K',
                            printf('%06d', left(a[4], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 3 ELSE 0 END) || substr(a[4], 7) || 'K') END,
                            printf('%06d', left(a[1], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 6 ELSE 3 END) || substr(a[1], 7) || 'R',
                            printf('%06d', left(a[2], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 6 ELSE 3 END) || substr(a[2], 7) || 'R',
                            printf('%06d', left(a[4], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 6 ELSE 3 END) || substr(a[4], 7) || 'R')
                   WHEN 4 THEN least(CASE WHEN x[1][1:1] = 'a' THEN
                            printf('%06d', left(a[3], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 3 ELSE 0 END) || substr(a[3], 7) || 'K' END,
                            printf('%06d', left(a[3], 6)::INT + CASE x[1][2:2] WHEN 't' THEN 6 ELSE 3 END) || substr(a[3], 7) || 'R')
            END END))],
        lambda v: list_transform([least(v[3], printf('%06d', left(v[1], 6)::INT + 3) || substr(v[1], 7) || 'I',
                printf('%06d', left(v[2], 6)::INT + 3) || substr(v[2], 7) || 'I', printf('%06d', left(v[4], 6)::INT + 3) || substr(v[4], 7) || 'I')],
            lambda u: [v[1], v[2], u, least(v[4], printf('%06d', left(u, 6)::INT + 3) || substr(u, 7) || 'I')])[1])[1]) AS fin FROM conv),
best AS (SELECT *, least(fin[1], fin[4]) AS b FROM run),
walk AS (SELECT *, left(b, 6)::BIGINT AS cost, substr(b, 8) AS audit FROM best),
-- one letter of the audit per step: state, row, result so far
steps AS (SELECT conv_id, i, audit[i:i] AS e, roles, texts,
        list_sum(list_transform(range(1, i + 1), lambda j: CASE WHEN audit[j:j] = 'I' THEN 0 ELSE 1 END))::INT AS r,
        coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN audit[j:j] = 'D' THEN 0 ELSE 1 END)), 0)::INT AS before
        FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM walk)),
lead AS (SELECT conv_id, max(CASE WHEN e = 'K' AND before = 0 AND roles[r][1:1] = 's' THEN 1 ELSE 0 END) AS s FROM steps GROUP BY conv_id),
outp AS (SELECT steps.conv_id, i, CASE WHEN e = 'K' THEN roles[r]
            WHEN (before - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE texts[r] END AS line
        FROM steps JOIN lead ON steps.conv_id IS NOT DISTINCT FROM lead.conv_id WHERE e <> 'D'),
sha AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM outp GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN walk ON ids.conv_id IS NOT DISTINCT FROM walk.conv_id LEFT JOIN sha ON ids.conv_id IS NOT DISTINCT FROM sha.conv_id
"""


@register("op11_four_russians_repair", _ORACLE)
def op11(spark, sf_dir):
    return repair_report(damage(spark.read.parquet(sf_path(sf_dir, "conversations"))))
