"""Per-row preparation of questions: clean -> language -> PII redaction.

All steps are column expressions except language detection, which joins the
broadcast n-gram profile and aggregates by the row id (one exchange of
``(id, score)`` rows, never of text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleanParams, PiiParams
from ..functions import pii
from ..functions import text as T
from ..operators import language


def split_valid(df: DataFrame, text_col: str = "text", params: CleanParams | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """(good, rejected).  A row is rejected when its text is missing or
    cleans to the empty string; rejected rows carry ``reject_reason``."""
    cleaned = T.clean(text_col, params)
    reason = (F.when(F.col(text_col).isNull(), F.lit("text_null"))
              .when(F.length(cleaned) < 1, F.lit("text_empty")))
    tagged = df.withColumn("reject_reason", reason)
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def prepare(df: DataFrame, profile: language.Profile, id_col: str = "query_id", text_col: str = "text",
            clean_params: CleanParams | None = None, pii_params: PiiParams | None = None,
            detect_pii: bool = True) -> DataFrame:
    """(id, original_text, cleaned_text, language, anonymized_text,
    text_length, cleaned_length, anonymized_length, pii_count)."""
    pp = pii_params or PiiParams()
    base = df.select(F.col(id_col), F.col(text_col).alias("original_text"),
                     T.clean(text_col, clean_params).alias("cleaned_text"))
    lang = language.detect(base, profile, id_col, "cleaned_text").select(id_col, "language")
    out = base.join(lang, id_col, "left")
    if detect_pii and pp.enabled:
        anon = pii.redact("cleaned_text", pp)
        count = sum((F.size(pii.matches("cleaned_text", e, pp)) for e in pii.patterns(pp)), F.lit(0))
    else:
        anon, count = F.col("cleaned_text"), F.lit(0)
    return out.select(
        F.col(id_col), "original_text", "cleaned_text", "language",
        anon.alias("anonymized_text"),
        F.length("original_text").cast("long").alias("text_length"),
        F.length("cleaned_text").cast("long").alias("cleaned_length"),
        F.length(anon).cast("long").alias("anonymized_length"),
        count.cast("long").alias("pii_count"),
    )
