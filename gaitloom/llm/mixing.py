"""Mixing sources to target weights by systematic sampling (problem 8).

Each source needs an expected number of copies of every document, its target tokens over its own,
at most its cap. Documents are laid in a row per source (by size class, then by hash), expected
copies are prefix-summed from one random start per source, and a copy is emitted at every integer
crossed. Prefix sums are ranks times the expectation; ranks come from counts per (source, class,
slice), so a source that holds most of the rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.llm.tokens import VOCABULARY, with_tokens
from gaitloom.session import durable

SLICE_ROWS = 200_000
#: Size classes per doubling of the length.
CLASSES = 4


def _sized(documents: DataFrame, path: str) -> DataFrame:
    return durable(with_tokens(documents, path))


def _rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int) -> DataFrame:
    """Per source of ``targets``: share, cap, tokens there are, expected copies, start."""
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("available"), F.count(F.lit(1)).alias("documents"))
    all_ = want.join(have, "source", "left").na.fill({"available": 0, "documents": 0})
    budget = F.lit(total_tokens).cast("double") if total_tokens else F.sum("available").over(Window.partitionBy()).cast("double")  # one row per source of the fixed target table
    rate = F.when(F.col("available") > 0, F.least(F.coalesce("target_share", F.lit(0.0)) * F.col("_budget") / F.col("available"), F.coalesce("max_repeats", F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(2**31)) / F.lit(float(2**31))
    return all_.withColumn("_budget", budget).withColumn("rate", F.greatest(rate, F.lit(0.0))).withColumn("start", start)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every chosen document, ``uses`` between 1 and the source's cap.

    ``total_tokens`` is the size asked for, by default what the named sources hold together. A source
    too small for its share, even repeated, gives every document its cap; one that is not there gives
    nothing; documents of a null or unnamed source are not chosen. Documents without tokens count as
    any other and cost nothing. Ties fall by hash and doc_id; a null share is 0, a null cap 1. An
    empty table gives no rows; rows without doc_id are left out; extra columns are ignored.
    """
    sized = _sized(documents, path)
    return _chosen(sized, _rates(sized, targets, total_tokens, seed), seed)


def _chosen(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    n_slices = max(1, -(-sized.count() // SLICE_ROWS))
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**40))
    rows = sized.where("source is not null").withColumn("h", h).withColumn("class", F.floor(F.log2(F.col("n_tokens") + 1) * CLASSES).cast("int")).withColumn("slice", F.floor(F.col("h") / (2**40 / n_slices)).cast("int"))
    per = rows.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per class and slice
    off = per.select(F.col("source").alias("_s"), F.col("class").alias("_c"), F.col("slice").alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("_local", F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("h", "doc_id")))
    rows = rows.join(off, (F.col("source") == F.col("_s")) & (F.col("class") == F.col("_c")) & (F.col("slice") == F.col("_l"))).withColumn("rank", F.col("offset") + F.col("_local"))
    rows = rows.join(rates.select(F.col("source").alias("_rs"), "rate", "start"), F.col("source") == F.col("_rs"))
    upto = lambda r: F.floor(F.round(r * F.col("rate") + F.col("start"), 9))
    return rows.withColumn("uses", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def mix_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, path: str = VOCABULARY) -> DataFrame:
    """Per source of ``targets``: target_share, actual_share, tokens, chosen documents and copies, largest use.

    Sources that are missing or too small are listed with what they give. Shares are of the tokens chosen.
    """
    sized = _sized(documents, path)
    rates = _rates(sized, targets, total_tokens, seed)
    got = _chosen(sized, rates, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("chosen"), F.sum("uses").alias("copies"), F.max("uses").alias("most_uses"))
    out = rates.select("source", "target_share", "max_repeats", "available", "documents").join(got, "source", "left").na.fill({"tokens": 0, "chosen": 0, "copies": 0, "most_uses": 0})
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return out.select("source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"), "max_repeats", "most_uses", "tokens", "available", "documents", "chosen", "copies")
