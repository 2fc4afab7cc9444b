"""Person names learnt from their contexts, from a few seed names.

Capitalised words are counted with what stands around them (the word before, the word
after, and both).  A context is *telling* when at least ``MIN_NAMES`` different known
names occur in it and it is bound to names: its pointwise mutual information with
"the word is a known name" is at least ``MIN_BITS``, or a quarter of what it can be at
most where names are frequent (most names are not known yet, so a context of names
alone does not reach its most).  A word becomes a name when it
occurs in at least ``MIN_CONTEXTS`` different telling contexts and at least
``MIN_SHARE`` of its capitalised occurrences are in one.  This repeats until no name
is added, at most ``rounds`` times.

Everything is an aggregate over one counted table (word, context, n), which is written
to the checkpoint folder and read in each round; texts are read once.  Names come back as
a table, and ``as_params`` gives the redaction parameters that hold them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PiiParams
from ..session import cut_lineage

# FIXED VALUES: words (an apostrophe or hyphen inside) and single marks; a name's shape.
TOKEN = r"(?U)\p{L}+(?:['’-]\p{L}+)*|[^\s\p{L}]"
NAME = r"^\p{Lu}\p{Ll}+(?:['’-]\p{Lu}?\p{Ll}+)*$"
MIN_NAMES, MIN_BITS, MIN_CONTEXTS, MIN_SHARE = 2, 2.0, 2, 0.3
MAX_LISTED = 10_000


def contexts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, context, n) of the capitalised words that do not begin a text; words are
    lower-cased in contexts."""
    tokens = texts.select(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), 0).alias("t"))
    padded = tokens.select(F.concat(F.array(F.lit("^")), "t", F.array(F.lit("$"))).alias("t"))
    around = F.transform(F.sequence(F.lit(2), F.greatest(F.size("t") - 1, F.lit(2))),
                         lambda i: F.struct(F.element_at("t", i).alias("word"), F.lower(F.element_at("t", i - 1)).alias("left"), F.lower(F.get("t", i)).alias("right")))
    found = padded.where(F.size("t") > 2).select(F.explode(F.filter(around, lambda x: x["word"].rlike(NAME))).alias("x")).select("x.*")
    kinds = F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"), F.concat(F.lit("B "), "left", F.lit(" "), "right"))
    return found.select("word", F.explode(kinds).alias("context")).groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


def learn(texts: DataFrame, seeds, text_col: str = "text", rounds: int = 8) -> DataFrame:
    """(name, round): the seeds (round 0) and the names found from them."""
    spark = texts.sparkSession
    counted = cut_lineage(contexts(texts, text_col))
    all_of_word = counted.where("context like 'B %'").groupBy("word").agg(F.sum("n").alias("all"))  # each occurrence has one of these
    total = counted.where("context like 'B %'").agg(F.sum("n")).first()[0] or 0
    names = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "name string").withColumn("round", F.lit(0))
    for step in range(1, rounds + 1):
        known = counted.join(names.select(F.col("name").alias("word")), "word", "left_semi")
        of_names = known.where("context like 'B %'").agg(F.sum("n")).first()[0] or 0
        if not of_names:
            break
        inside = known.groupBy("context").agg(F.sum("n").alias("named"), F.count(F.lit(1)).alias("names"))
        size = counted.join(inside.where(F.col("names") >= MIN_NAMES).select("context"), "context", "left_semi").groupBy("context").agg(F.sum("n").alias("size"))
        bits = F.log2(F.col("named") * F.lit(float(total)) / (F.col("size") * F.lit(float(of_names))))
        telling = size.join(inside, "context").where(bits >= F.least(F.lit(MIN_BITS), 0.25 * F.log2(F.lit(float(total) / of_names)))).select("context")
        kinds = [F.sum(F.when(F.col("context").startswith(k), F.col("n")).otherwise(0)).alias(f"_{k}") for k in "BLR"]
        met = counted.join(telling, "context", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("contexts"), *kinds)
        share = F.greatest("_B", "_L", "_R") / F.col("all")
        new = (met.join(all_of_word, "word").where((F.col("contexts") >= MIN_CONTEXTS) & (share >= MIN_SHARE))
               .select(F.col("word").alias("name")).join(names, "name", "left_anti").withColumn("round", F.lit(step)))
        new = cut_lineage(new)
        if not new.head(1):
            break
        names = names.unionByName(new)
    return names


def as_params(names: DataFrame, params: PiiParams | None = None) -> PiiParams:
    """Redaction parameters with the names (a pattern, so at most ``MAX_LISTED``)."""
    rows = names.select("name").limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} names; join them instead")
    return replace(params or PiiParams(), person_names=tuple(sorted(r["name"] for r in rows)))
