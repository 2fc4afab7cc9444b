"""DuckDB fragments restating the decision and context jobs."""

from __future__ import annotations

from ..config import DecisionParams
from ..operators import context as C
from ..operators import decision as D
from .sql_text import q


def _list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def words(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '[\\pL\\pM\\pN_]+')"


def polar_counts(t: str) -> str:
    """Columns pos, neg, n_chars for a subquery."""
    w = words(t)
    return (f"len(list_filter({w}, lambda x: list_contains({_list(D.POSITIVE_WORDS)}, x))) AS pos, "
            f"len(list_filter({w}, lambda x: list_contains({_list(D.NEGATIVE_WORDS)}, x))) AS neg, "
            f"length(coalesce({t}, '')) AS n_chars")


SENTIMENT_LABEL = ("CASE WHEN n_chars = 0 THEN 'neutral' WHEN pos > neg THEN 'positive' "
                   "WHEN neg > pos THEN 'negative' ELSE 'neutral' END")
SENTIMENT_SCORE = ("CASE WHEN n_chars = 0 THEN 0.5 WHEN pos + neg > 0 THEN 0.5 + 0.5 * abs(pos - neg) / (pos + neg) "
                   "ELSE 0.5 END")


def any_kw(t: str, kws) -> str:
    return f"(len(list_filter({_list(kws)}, lambda k: contains(lower(coalesce({t}, '')), k))) > 0)"


def count_kw(t: str, kws) -> str:
    return f"len(list_filter({_list(kws)}, lambda k: contains(lower(coalesce({t}, '')), k)))"


def urgent(t: str, p: DecisionParams | None = None) -> str:
    p = p or DecisionParams()
    return any_kw(t, p.urgent_keywords)


def topics(t: str, p: DecisionParams | None = None) -> tuple[str, str, str]:
    """(has_sensitive, topics joined by ',', topic confidence)."""
    p = p or DecisionParams()
    empty = f"length(coalesce({t}, '')) = 0"
    anys = [any_kw(t, kws) for _, kws in p.topics]
    has = f"(NOT ({empty}) AND ({' OR '.join(anys)}))"
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {a} THEN {q(n)} END" for a, (n, _) in zip(anys, p.topics)) + ")"
    names = f"CASE WHEN {empty} THEN '' ELSE {names} END"
    matches = " + ".join(count_kw(t, kws) for _, kws in p.topics)
    conf = f"CASE WHEN {empty} THEN 0.0 ELSE least(1.0, ({matches}) / 5.0) END"
    return has, names, conf


def confidence(hits: str, name: str = "conf", score: str = "combined_score") -> str:
    in3 = "rank <= 3"
    return f"""
{name} AS (
  SELECT query_id, count(*) AS n_hits,
    greatest(0.0, least(1.0,
      0.4 * max(CASE WHEN rank = 1 THEN {score} END)
      + 0.3 * (CASE WHEN count(CASE WHEN {in3} THEN {score} END) > 1
                    THEN greatest(0.0, least(1.0, 1.0 - stddev_pop(CASE WHEN {in3} THEN {score} END)
                                                  / (avg(CASE WHEN {in3} THEN {score} END) + 1e-9)))
                    ELSE 1.0 END)
      + 0.3 * least(1.0, count(CASE WHEN {score} >= 0.3 THEN 1 END) / 3.0))) AS confidence
  FROM {hits} GROUP BY query_id
)
"""


def prompt_parts() -> tuple[str, str, str]:
    return tuple(q(x) for x in C._template_parts())
