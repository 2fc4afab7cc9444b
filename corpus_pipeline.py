"""The corpus pipeline: quality classifier, near-duplicate removal, benchmark
decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it again as the next stage's
documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsman.llm import decontaminate, extendible, mixing, neardup, quality
from helmsman.llm.shared import documents, written
from helmsman.session import sf_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score >= 0.3)."""
    model = quality.quality_model(spark, docs, sf_dir)
    return quality.score(docs, model).where(F.col("_quality") >= quality.THRESHOLD).drop("_quality")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five
    words, similarity 0.8); rows that repeat an id and its text stay once."""
    found = neardup.near_duplicates(docs, shingle=5)
    kept = written(found.where("kept").groupBy(F.col("doc_id").alias("_kept")).count(), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept"))
    once = docs.join(kept.where("count = 1"), same, "left_semi")
    repeated = kept.where("count > 1")
    if not repeated.head(1):
        return once
    return once.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    scanned = decontaminate.scan(docs, spark.read.parquet(sf_path(sf_dir, "benchmark")))
    return scanned.where(F.size("_wm_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return extendible.report(extendible.assign(docs), *docs.columns)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None  # a trained model and hash-ranked samples; see tests/llm/test_models_and_groups.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
