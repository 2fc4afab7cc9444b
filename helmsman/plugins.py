"""Plug-in points for models (embedding, sentiment, generation, tokens).

Each wraps a user function in an Arrow-batched Spark call; nothing here runs
a model by itself.  The built-in defaults live in the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import EMBED_BATCH, SENTIMENT_MAX_CHARS


def batched_embedder(encode: Callable[[list[str]], np.ndarray], dim: int, batch_size: int = EMBED_BATCH,
                     text_col: str = "text", out_col: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """V1 plug-in: ``encode(list_of_texts) -> (n, dim) array`` is called on
    batches of ``batch_size`` rows inside ``mapInPandas``; rows are L2
    normalised; an empty text raises (as the source model service does)."""

    def apply(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = pdf[text_col].fillna("").tolist()
                if any(t == "" for t in texts):
                    raise ValueError("empty text cannot be embedded")
                out = []
                for i in range(0, len(texts), batch_size):
                    m = np.asarray(encode(texts[i:i + batch_size]), dtype=np.float64)
                    if m.ndim != 2 or m.shape[1] != dim:
                        raise ValueError(f"embedding dimension {m.shape} != {dim}")
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    out.extend(list((m / np.where(n > 0, n, 1.0)).astype(np.float32)))
                yield pdf.assign(**{out_col: out})

        return df.mapInPandas(run, schema)

    return apply


def sentiment_model(classify: Callable[[list[str]], list[tuple[str, float]]]) -> Callable[[Column], Column]:
    """D4 plug-in: ``classify(texts) -> [(raw_label, score)]``; the label is
    normalised by substring (pos -> positive, neg -> negative, else neutral);
    an empty text is neutral 0.5; the model sees the first 512 characters."""
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        t = texts.fillna("")
        res = [("neutral", 0.5)] * len(t)
        idx = [i for i, x in enumerate(t) if x]
        if idx:
            out = classify([t.iloc[i][:SENTIMENT_MAX_CHARS] for i in idx])
            for i, (lab, sc) in zip(idx, out):
                low = str(lab).lower()
                norm = "positive" if "pos" in low else ("negative" if "neg" in low else "neutral")
                res[i] = (norm, float(sc))
        return pd.DataFrame(res, columns=["label", "score"])

    return lambda c: run(c)


def generator(generate: Callable[[list[str]], list[str]], name: str
              ) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """G3 plug-in for ``mapInPandas`` over (query_id, prompt, context)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = generate(pdf["prompt"].tolist())
            yield pd.DataFrame({"query_id": pdf["query_id"], "response_text": texts, "generated_by": name})

    return run


def tokenizer(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """Tokenizer plug-in: Column -> array<string>."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(split)

    return lambda c: run(c)
