"""Column expressions for text preparation (cleaning, tokens, validation).

Every function maps Column -> Column and stays inside whole-stage codegen.
Regexes use Java's ``(?U)`` flag so ``\\s``, ``\\w`` and ``\\b`` follow Unicode,
as Python's ``re`` does on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CleanParams, MAX_TOKENS, SENTIMENT_MAX_CHARS

HTML_TAG = r"<[^>]+>"
MD_LINK = r"\[([^\]]+)\]\([^\)]+\)"
MD_MARKS = r"[*_`~]"
WHITESPACE = r"(?U)\s+"
PUNCT_RUN = r"([!?.]){2,}"
WORD_TOKEN = r"(?U)\w+|[^\w\s]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_markup(c) -> Column:
    """Drop HTML tags, keep markdown link text, drop * _ ` ~."""
    c = _col(c)
    c = F.regexp_replace(c, HTML_TAG, "")
    c = F.regexp_replace(c, MD_LINK, "$1")
    return F.regexp_replace(c, MD_MARKS, "")


def py_strip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c) -> Column:
    """Every whitespace run (newlines too) becomes one space; trimmed."""
    return py_strip(F.regexp_replace(_col(c), WHITESPACE, " "))


def collapse_punctuation(c) -> Column:
    """A run of two or more of ! ? . becomes the last char of the run."""
    return F.regexp_replace(_col(c), PUNCT_RUN, "$1")


def expand_abbreviations(c, table=None) -> Column:
    """P5: whole-word, case-insensitive expansion, in table order.

    One combined ``rlike`` decides whether a text holds any abbreviation at
    all; only those texts pay for the ordered replacement passes."""
    c = _col(c)
    pairs = list(table if table is not None else CleanParams().abbreviations)
    if not pairs:
        return c
    x = c
    for short, full in pairs:
        x = F.regexp_replace(x, rf"(?iU)\b{short}\b", full)
    any_abbr = rf"(?iU)\b(?:{'|'.join(short for short, _ in pairs)})\b"
    return F.when(c.rlike(any_abbr), x).otherwise(c)


def clean(c, params: CleanParams | None = None) -> Column:
    """Html -> whitespace -> lowercase? -> punctuation -> typos -> strip.

    Disabled cleaning returns the input unchanged; null becomes ''."""
    p = params or CleanParams()
    c = _col(c)
    if not p.enabled:
        return c
    x = F.coalesce(c, F.lit(""))
    if p.remove_html:
        x = strip_markup(x)
    if p.normalize_whitespace:
        x = normalize_whitespace(x)
    if p.lowercase:
        x = F.lower(x)
    x = collapse_punctuation(x)
    x = expand_abbreviations(x, p.abbreviations)
    return py_strip(x)


def word_tokens(c) -> Column:
    """Word tokens and single punctuation marks."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_TOKEN), 0)


def bm25_tokens(c) -> Column:
    """Lowercase, split on whitespace, punctuation kept, no empty tokens."""
    return F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), WHITESPACE), lambda t: t != "")


def model_input(c, max_chars: int = SENTIMENT_MAX_CHARS) -> Column:
    """The first ``max_chars`` characters, the input limit of a model
    plug-in.  Built-in jobs score whole texts."""
    return F.substring(_col(c), 1, max_chars)


def validate_query(text, top_k=None) -> tuple[Column, Column]:
    """(is_valid, reject_reason) for a query request."""
    text = _col(text)
    reason = F.when(text.isNull(), F.lit("text_null")).when(F.length(text) < 1, F.lit("text_empty"))
    if top_k is not None:
        k = _col(top_k)
        reason = reason.when(k.isNotNull() & ((k < 1) | (k > 20)), F.lit("top_k_out_of_range"))
    return reason.isNull(), reason


def validate_feedback(value) -> tuple[Column, Column]:
    v = _col(value)
    reason = F.when(v.isNull(), F.lit("value_null")).when((v < -1) | (v > 1), F.lit("value_out_of_range"))
    return reason.isNull(), reason


def truncate_tokens(tokens, max_len: int = MAX_TOKENS) -> Column:
    return F.slice(_col(tokens), 1, max_len)
