"""Mixing sources to target weights by Pareto order sampling, with DataFrame
operations only.

Targets.  Sources in code point order (null last) have weights 3, 1, 2,
repeating, and share ``ratio`` times the words of all documents; a target stops
at ``most`` times its source's words and the excess is reshared by weight until
none is above.

Sample.  A source whose target is k whole copies and a rest takes every document
k times (the certain copies) and, for the rest, a sample of fixed size in words:
documents are ranked by random odds u / (1 - u) divided by their inclusion odds,
and the first ones are taken until their words reach the rest.  Inclusion odds
grow with the logarithm of a document's bytes (the factor that all documents of
a source share does not change the ranking).  ``u`` is a hash of id and text, so
reruns agree.  The rank's cut is found without sorting a source: its 52-bit rank
keys are summed by their first 13 bits, then, inside the cut's cell, by the next
13, and only the last cell (one in 67 million) is ordered.  One closing document
whose size is nearest to the words still missing follows, if it comes nearer.

Defined results: null texts have size 0; a source without words has target 0; a
null source is a source; rows that repeat id, text and source are taken alike;
an empty table gives no rows; other columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import register
from .shared import documents, small_side, written

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS, DIGIT_BITS, LEVELS = 52, 13, 2


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source() -> Column:
    """The source as a join key; null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))


def _rank_key() -> Column:
    """Pareto rank as a 52-bit number: q / (1 + q) for q = random odds / odds."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    odds = 1 + F.log1p(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("double"))
    q = u / (1 - u) / odds
    return F.floor(q / (1 + q) * float(1 << KEY_BITS)).cast("long")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def slim(docs: DataFrame) -> DataFrame:
    """What the sampling needs of each document, written once."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("_mx_id"), _source().alias("_mx_source"),
                               _size().alias("size"), _rank_key().alias("_mx_key")), "mixing")


def targets(rows: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_mx_source, source_size, target, copies, rest) per source, written."""
    spark = rows.sparkSession
    # "~" sorts after "=..."; a sorted write and per-partition counts number the sources.
    ordered = written(rows.groupBy("_mx_source").agg(F.sum("size").alias("source_size")).orderBy("_mx_source")
                      .withColumn("_mx_at", F.monotonically_increasing_id()), "mixing")
    part = F.shiftrightunsigned("_mx_at", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())  # one row per partition
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    offset = spark.createDataFrame(offsets or [(0, 0)], "p long, offset long")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("offset") + F.col("_mx_at").bitwiseAND((1 << 33) - 1)) % len(weights)).cast("int"))
    src = written(ordered.join(F.broadcast(offset), part == F.col("p"))
                  .select("_mx_source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "mixing")
    total = ratio * (src.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # target = min(cap, level * weight)
    while True:
        closed = F.col("cap") < level * F.col("weight")
        full, weight_left = src.agg(F.sum(F.when(closed, F.col("cap"))), F.sum(F.when(~closed, F.col("weight")))).first()
        new = (total - (full or 0.0)) / weight_left if weight_left else level
        if new <= level:
            break
        level = new
    target = F.least("cap", F.lit(level) * F.col("weight"))
    copies = F.when(F.col("source_size") == 0, 0).when(target >= F.col("cap"), most).otherwise(F.floor(target / F.col("source_size"))).cast("long")
    return written(src.select("_mx_source", "source_size", target.alias("target"), copies.alias("copies"),
                              F.greatest(F.lit(0.0), target - copies * F.col("source_size")).alias("rest")), "mixing")


def _in_cell(rows: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    return rows.join(small_side(state), "_mx_source").where(F.shiftright("_mx_key", KEY_BITS - bits) == F.col("cell"))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with the cut of each source: keys whose first 26 bits are below
    ``cell`` are in; inside the cell (key, id) up to (last_key, last_id) is; and
    the closing document (close_key, close_id).  Nulls: nothing there."""
    by_source = Window.partitionBy("_mx_source")
    state = goals.where("rest > 0").select("_mx_source", F.col("rest").alias("need"), F.lit(0).cast("long").alias("cell"))
    for level in range(LEVELS):
        digit = F.shiftright("_mx_key", KEY_BITS - DIGIT_BITS * (level + 1))
        sums = _in_cell(rows, state, DIGIT_BITS * level).groupBy("_mx_source", digit.alias("cell")).agg(F.sum("size").alias("s"), F.first("need").alias("need"))
        upto = F.sum("s").over(by_source.orderBy("cell"))
        state = written(sums.withColumn("upto", upto).where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("s") <= F.col("need")))
                        .select("_mx_source", (F.col("need") - F.col("upto") + F.col("s")).alias("need"), "cell"), "mixing")
    inside = _in_cell(rows, state, DIGIT_BITS * LEVELS).groupBy("_mx_source", "_mx_key", "_mx_id").agg(F.sum("size").alias("s"), F.first("need").alias("need"))
    upto = F.sum("s").over(by_source.orderBy("_mx_key", "_mx_id"))
    last = (inside.withColumn("upto", upto).where("upto <= need").groupBy("_mx_source")
            .agg(F.max(F.struct("upto", "_mx_key", "_mx_id")).alias("last")))
    state = written(state.join(last, "_mx_source", "left").select(
        "_mx_source", "cell", F.col("last._mx_key").alias("last_key"), F.col("last._mx_id").alias("last_id"),
        (F.col("need") - F.coalesce(F.col("last.upto"), F.lit(0))).alias("gap")), "mixing")
    off = F.abs(F.col("size") - F.col("gap"))
    closing = (rows.join(small_side(state), "_mx_source").where(~_before_cut() & (off < F.col("gap")))
               .groupBy("_mx_source").agg(F.min(F.struct(off, "_mx_key", "_mx_id")).alias("c"))
               .select("_mx_source", F.col("c._mx_key").alias("close_key"), F.col("c._mx_id").alias("close_id")))
    closing = written(closing, "mixing")
    alone = (rows.join(small_side(closing), "_mx_source").where("_mx_key = close_key and _mx_id = close_id")
             .groupBy("_mx_source", "close_key", "close_id").count().where("count = 1").drop("count"))
    return written(goals.join(state.drop("gap"), "_mx_source", "left").join(alone, "_mx_source", "left"), "mixing")


def _before_cut() -> Column:
    cell = F.shiftright("_mx_key", KEY_BITS - DIGIT_BITS * LEVELS)
    in_cell = (F.col("_mx_key") < F.col("last_key")) | ((F.col("_mx_key") == F.col("last_key")) & (F.col("_mx_id") <= F.col("last_id")))
    return (cell < F.col("cell")) | ((cell == F.col("cell")) & F.coalesce(in_cell, F.lit(False)))


def _copies() -> Column:
    closing = (F.col("_mx_key") == F.col("close_key")) & (F.col("_mx_id") == F.col("close_id"))
    sampled = F.coalesce(_before_cut(), F.lit(False)) | F.coalesce(closing, F.lit(False))
    return F.coalesce(F.col("copies"), F.lit(0)) + sampled.cast("long")


def plan(docs: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): the slim rows and each source's target and cut."""
    rows = slim(docs)
    return rows, cuts(rows, targets(rows, ratio, weights, most))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    _, cut = plan(docs, **parameters)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("_mx_row"), _id().alias("_mx_id"), _source().alias("_mx_source"), _rank_key().alias("_mx_key"))
    taken = own.join(small_side(cut), "_mx_source").withColumn("_mx_copies", _copies().cast("int")).where("_mx_copies > 0")
    return taken.select("_mx_row", F.explode(F.sequence(F.lit(1), F.col("_mx_copies"))).alias("_mx_copy")).select("_mx_row.*")


@register("op2_pareto_mixing")
def op2(spark, sf_dir):
    rows, cut = plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.join(small_side(cut), "_mx_source").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))
