"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions
only near its hits, then validation of embedded checksums.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped):
``assign`` a keyword assignment whose value has 6 or more characters, ``access``
an AKIA key of 20 or more, ``hex`` a run of 24 or more lower-case hex digits.
``hex`` has no keyword; its prefilter is a vectorised search for long runs.
Added kinds: ``github`` and ``npm`` tokens, kept only when the base-62 CRC-32 in
their last six characters is right.  A kind is a ``Rule``; callers may add more.

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive; a secret found by two kinds gives two spans; repeated rows are
reported once per row; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import register
from .shared import documents, slices, text_buffer

_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(token: bytes) -> bool:
    """The last six characters are the base-62 CRC-32 of the 30 before them."""
    number, digits = zlib.crc32(token[-36:-6]), b""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = _BASE62[digit: digit + 1] + digits
    return digits == token[-6:]


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]  # lower case, ASCII
    pattern: bytes
    valid: Callable[[re.Match], bool]


# FIXED VALUES: kinds and patterns of the base scan, then the added token formats.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[1]) >= 6),
    Rule("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", (), rb"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc_token(m[0])),
    Rule("npm", ("npm_",), rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc_token(m[0])),
)
BASE = ("assign", "access", "hex")
HEX_LEAST = 24

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def _automaton(rules) -> ahocorasick.Automaton:
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for word in rule.keywords:
            by_word.setdefault(word, []).append(i)
    out = ahocorasick.Automaton()
    for word, kinds in by_word.items():
        out.add_word(word, (len(word), tuple(kinds)))
    if by_word:
        out.make_automaton()
    return out


def find(raw: np.ndarray, off: np.ndarray, rules, automaton) -> dict[int, list[tuple[int, str, int, int]]]:
    """row -> [(byte start, kind, code point start, end)], ordered by start, then rule."""
    buf = np.insert(raw, off[1:], 10)  # a line feed ends each row; no pattern crosses it
    data = buf.tobytes()
    hits: list[tuple[int, int]] = []
    if len(automaton):
        for last, (length, kinds) in automaton.iter(data.lower().decode("latin-1")):
            hits += [(k, last - length + 1) for k in kinds]
    edge = np.diff(_HEX[buf].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_runs = starts[ends - starts >= HEX_LEAST].tolist()
    for i, rule in enumerate(rules):
        if not rule.keywords:
            hits += [(i, at) for at in long_runs]
    hits.sort()
    compiled = [re.compile(rule.pattern) for rule in rules]
    spans, kind, free = [], -1, 0
    for i, at in hits:
        if i != kind:
            kind, free = i, 0
        if at < free:
            continue
        match = compiled[i].match(data, at)
        if match:
            free = match.end()
            if rules[i].valid(match):
                spans.append((match.start(), i, match.end()))
    out: dict[int, list] = {}
    row_at = off + np.arange(len(off))
    for start, i, end in sorted(spans):
        row = int(np.searchsorted(row_at, start, "right")) - 1
        out.setdefault(row, []).append((start, rules[i].kind, end))
    for row, found in out.items():
        point = np.cumsum((buf[row_at[row]: row_at[row + 1]] & 0xC0) != 0x80)
        base = int(row_at[row])
        out[row] = [(kind, int(point[s - base]) - 1, int(point[e - 1 - base])) for s, kind, e in found]
    return out


_SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_secrets``: array of (kind, start, end) in order of start."""

    def run(batches):
        automaton = _automaton(rules)
        for batch in slices(batches, "text"):
            raw, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            found = find(raw, off, rules, automaton)
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in found.get(r, ())] for r in range(batch.num_rows)], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "_secrets"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_secrets", _SECRETS)]))


def report(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("_secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_secrets", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"),
                          joined(F.col("_secrets")).alias("spans"))


@register("op10_aho_corasick_secrets")
def op10(spark, sf_dir):
    return report(scan(documents(spark, sf_dir).select("doc_id", "text")))
