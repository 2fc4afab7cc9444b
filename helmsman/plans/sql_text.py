"""DuckDB expression builders restating the text and PII column functions.

RE2 (DuckDB) has ASCII ``\\b``; the Unicode word boundary used on the Spark side
is written here as an explicit non-word class around the word.
"""

from __future__ import annotations

import re

from ..config import ABBREVIATIONS, PII_DEFAULT_LABEL, PiiParams
from ..functions import pii as P

NONWORD = r"[^\pL\pM\pN_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str, lowercase: bool = False) -> str:
    s = f"coalesce({x}, '')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    s = f"regexp_replace({s}, '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g')"
    s = f"regexp_replace({s}, '[*_`~]', '', 'g')"
    s = strip(f"regexp_replace({s}, '\\s+', ' ', 'g')")
    if lowercase:
        s = f"lower({s})"
    s = f"regexp_replace({s}, '([!?.]){{2,}}', '\\1', 'g')"
    for short, full in ABBREVIATIONS:
        s = f"regexp_replace({s}, '(^|{NONWORD}){short}({NONWORD}|$)', '\\1{full}\\2', 'gi')"
    return strip(s)


def bm25_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda t: t <> '')"


def luhn(m: str) -> str:
    d = f"reverse(regexp_replace({m}, '[^0-9]', '', 'g'))"
    digit = f"CAST(substring({d}, i + 1, 1) AS INTEGER)"
    term = f"CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"(length({d}) > 0 AND coalesce(list_sum(list_transform(range(length({d})), lambda i: {term})), 0) % 10 = 0)"


def person_pattern(names) -> str:
    return "(^|" + NONWORD + ")(" + "|".join(re.escape(n) for n in names) + ")(" + NONWORD + "|$)"


def matches(x: str, entity: str, params: PiiParams | None = None) -> str:
    p = params or PiiParams()
    pat = {"EMAIL_ADDRESS": P.EMAIL_RE, "CREDIT_CARD": P.CARD_RE, "SSN": P.SSN_RE,
           "PHONE_NUMBER": P.PHONE_RE}.get(entity)
    if entity == "PERSON":
        found = f"list_transform(regexp_extract_all({x}, {q(person_pattern(p.person_names))}, 2), lambda m: m)"
        return found
    found = f"regexp_extract_all(coalesce({x}, ''), {q(pat)})"
    if entity == "CREDIT_CARD":
        found = f"list_filter({found}, lambda m: {luhn('m')})"
    return found


def redact(x: str, params: PiiParams | None = None) -> str:
    p = params or PiiParams()
    s = f"coalesce({x}, '')"
    labels = dict(P.PII_LABELS)
    for e in P.ORDER:
        if e not in p.entities:
            continue
        if p.strategy == "replace" or p.strategy not in ("mask", "hash"):
            label = labels[e] if p.strategy == "replace" else PII_DEFAULT_LABEL
            if e == "CREDIT_CARD":
                s = f"list_reduce({matches(s, e, p)}, lambda acc, m: replace(acc, m, {q(label)}), {s})"
            elif e == "PERSON":
                s = f"regexp_replace({s}, {q(person_pattern(p.person_names))}, {q(chr(92) + '1' + label + chr(92) + '3')}, 'g')"
            else:
                pat = {"EMAIL_ADDRESS": P.EMAIL_RE, "SSN": P.SSN_RE, "PHONE_NUMBER": P.PHONE_RE}[e]
                s = f"regexp_replace({s}, {q(pat)}, {q(label)}, 'g')"
        elif p.strategy == "mask":
            s = (f"list_reduce({matches(s, e, p)}, lambda acc, m: replace(acc, m, "
                 f"repeat('*', least(length(m), 100)) || substring(m, 101)), {s})")
        else:  # hash
            s = f"list_reduce({matches(s, e, p)}, lambda acc, m: replace(acc, m, sha256(m)), {s})"
    return s


def redaction_ctes(table: str, key: str, x: str, params: PiiParams | None = None) -> str:
    """CTEs ``pii_spans`` (key, entity_type, start_at, end_at) and ``pii_redacted``
    (key, redacted) over ``table``: offsets of each entity on the original text,
    kept by precedence, then the text rebuilt from pieces.  Names are located by
    word runs, the other entities by the lengths of the pieces between matches."""
    p = params or PiiParams()
    regexes = {"EMAIL_ADDRESS": P.EMAIL_RE, "CREDIT_CARD": P.CARD_RE, "SSN": P.SSN_RE, "PHONE_NUMBER": P.PHONE_RE}
    names = ", ".join(q(n) for n in p.person_names)
    ctes, kept = [f"pii_t AS (SELECT {key}, coalesce({x}, '') AS t FROM {table})"], []
    for i, e in enumerate(e for e in P.ORDER if e in p.entities):
        if e == "PERSON":
            runs = "regexp_extract_all(t, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_]+')"
            raw = (f"SELECT {key}, m, CAST(sum(length(m)) OVER (PARTITION BY {key} ORDER BY k) AS BIGINT) AS e FROM "
                   f"(SELECT {key}, unnest({runs}) AS m, generate_subscripts({runs}, 1) AS k FROM pii_t)")
            ok = f"m IN ({names})"
        else:
            pieces, found = f"regexp_split_to_array(t, {q(regexes[e])})", f"regexp_extract_all(t, {q(regexes[e])})"
            raw = (f"SELECT {key}, m, CAST(sum(length(m) + length(piece)) OVER (PARTITION BY {key} ORDER BY k) AS BIGINT) AS e FROM "
                   f"(SELECT {key}, unnest({found}) AS m, unnest({pieces}[1:len({found})]) AS piece, generate_subscripts({found}, 1) AS k FROM pii_t WHERE len({found}) > 0)")
            ok = luhn("m") if e == "CREDIT_CARD" else "true"
        ctes.append(f"pii_r{i} AS (SELECT {key}, {q(e)} AS entity_type, e - length(m) AS s, e, m FROM ({raw}) WHERE {ok})")
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM pii_k{j} b WHERE b.{key} = a.{key} AND a.s < b.e AND b.s < a.e)" for j in kept) or "true"
        ctes.append(f"pii_k{i} AS (SELECT * FROM pii_r{i} a WHERE {free})")
        kept.append(i)
    ctes.append("pii_spans AS (" + " UNION ALL ".join(f"SELECT * FROM pii_k{i}" for i in kept) + ")")
    if p.strategy == "mask":
        new = "repeat('*', least(length(m), 100)) || substring(m, 101)"
    elif p.strategy == "hash":
        new = "sha256(m)"
    elif p.strategy == "replace":
        new = "CASE entity_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.PII_LABELS) + " END"
    else:
        new = q(PII_DEFAULT_LABEL)
    ctes.append(f"""pii_redacted AS (
  SELECT t.{key}, coalesce(w.out || substring(t.t, CAST(w.last AS BIGINT) + 1), t.t) AS redacted
  FROM pii_t t LEFT JOIN (
    SELECT {key}, string_agg(before || new, '' ORDER BY s) AS out, max(e) AS last FROM (
      SELECT {key}, s, e, {new} AS new,
             substring(t, CAST(coalesce(lag(e) OVER o, 0) AS BIGINT) + 1, CAST(s - coalesce(lag(e) OVER o, 0) AS BIGINT)) AS before
      FROM pii_spans JOIN pii_t USING ({key}) WINDOW o AS (PARTITION BY {key} ORDER BY s))
    GROUP BY {key}) w ON w.{key} = t.{key})""")
    return ",\n".join(ctes)
