"""Distributed row numbering (ranks in a global order, optionally per group).

``repartitionByRange`` splits the rows (and any hot group) over many range
partitions; each task numbers its rows locally (``monotonically_increasing_id``
after a sort within the partition).  These numbered slices are written once into
the shared checkpoint folder: the counts that give each partition its offset and
the rows that take it are read from the same files, so both see the same bounds
whatever columns the rows carry, and the input is computed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

BROADCAST_COUNT_ROWS = 1_000_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbered_slices(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` with _pid (partition) and
    _mid (increasing inside it), written and read back."""
    spark = df.sparkSession
    local = (df.repartitionByRange(partitions or _partitions(df), *keys).sortWithinPartitions(*keys)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    path = scratch_path(spark, f"numbering-{uuid.uuid4().hex}")
    local.write.parquet(path)
    return spark.read.schema(local.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], group_cols: list[str] | None = None,
           rank_col: str = "rank0", count_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position of each row in ``order`` within its
    group (and ``count_col`` = group size when given)."""
    groups = list(group_cols or [])
    keys = [F.col(g) for g in groups] + list(order)
    local = _numbered_slices(df, keys, partitions)
    counts = local.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_pn"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid")
    offs = counts.withColumn("_off", F.sum("_pn").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_pn"))
    if count_col:
        tot = Window.partitionBy(*groups) if groups else Window.partitionBy()
        offs = offs.withColumn(count_col, F.sum("_pn").over(tot))
    offs = offs.drop("_pn")
    # counts has one row per (range partition, group): bounded by partitions x groups.
    small = offs.count() <= BROADCAST_COUNT_ROWS
    right = F.broadcast(offs) if small else offs
    out = local.join(right, ["_pid", *groups])
    out = out.withColumn(rank_col, F.col("_off") + F.col("_mid") - F.col("_m0"))
    return out.drop("_pid", "_mid", "_off", "_m0")


def assign_ids(df: DataFrame, order: list[Column], start: int = 1, id_col: str = "id") -> DataFrame:
    """Dense ids ``start, start+1, ...`` in the global ``order``."""
    return ranked(df, order, rank_col="_r").withColumn(id_col, F.col("_r") + F.lit(start)).drop("_r")


def exact_quantiles(df: DataFrame, value_col: str, qs: list[float], group_cols: list[str] | None = None
                    ) -> DataFrame:
    """Exact quantiles with linear interpolation (position q*(N-1), as
    ``percentile``/``quantile_cont``): one row per (group..., q, value).

    Equal values are counted first, so one value that fills a third of the table
    is a single row from then on; the distinct values are numbered by their
    counts and only those that cover a wanted position are kept."""
    groups = list(group_cols or [])
    base = df.filter(F.col(value_col).isNotNull()).select(*groups, F.col(value_col).cast("double").alias("_v"))
    values = base.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    local = _numbered_slices(values, [F.col(g) for g in groups] + [F.col("_v")], None)
    counts = local.groupBy("_pid", *groups).agg(F.sum("_c").alias("_pn"))
    w = Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid")
    offs = counts.withColumn("_off", F.sum("_pn").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_pn"))
    offs = offs.withColumn("_cnt", F.sum("_pn").over(Window.partitionBy(*groups))).drop("_pn")
    small = offs.count() <= BROADCAST_COUNT_ROWS
    slice_order = Window.partitionBy("_pid", *groups).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    r = (local.withColumn("_upto", F.sum("_c").over(slice_order))
         .join(F.broadcast(offs) if small else offs, ["_pid", *groups])
         .withColumn("_end", F.col("_off") + F.col("_upto"))
         .withColumn("_start", F.col("_end") - F.col("_c")))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    pos = F.col("q") * (F.col("_cnt") - 1)
    low = (F.floor("_pos") >= F.col("_start")) & (F.floor("_pos") < F.col("_end"))
    high = (F.ceil("_pos") >= F.col("_start")) & (F.ceil("_pos") < F.col("_end"))
    wanted = r.select(*groups, "_start", "_end", "_v", "_cnt", F.explode(qarr).alias("q")).withColumn("_pos", pos).filter(low | high)
    agg = wanted.groupBy(*groups, "q").agg(
        F.first("_pos").alias("_pos"),
        F.min(F.when(low, F.col("_v"))).alias("_lo"),
        F.min(F.when(high, F.col("_v"))).alias("_hi"),
    )
    val = F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_hi") - F.col("_lo"))
    return agg.select(*groups, "q", val.alias("value"))
