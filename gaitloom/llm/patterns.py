"""Frequent subsequences across many sequences by prefix-projected pattern growth (problem 3).

Plan. Each recording's syllables become entries (equal neighbours once) inside time blocks; the
next few entries beyond a block come from the heads of the following blocks, found over one narrow row
per block and joined back by (recording, block). Every entry carries its projected suffix, the ``(length - 1) * (gap + 1)`` entries after it,
so growing a prefix is a narrow step without a join. After each step the supports are counted, every
recording once, and only pointers of frequent prefixes grow further. Prefixes are distributed by
hash; a prefix that occurs everywhere is first reduced to one row per (prefix, recording).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.tables import by_block, in_force


def entries(results: DataFrame, ahead: int) -> DataFrame:
    """(recording, suffix): one row per entry, ``suffix`` being the entry and up to ``ahead`` entries after it.

    Null syllables are left out, equal neighbours are one entry whatever lies between their frames.
    """
    rows = in_force(by_block(results.select("recording", "frame", "loaded_at", "syllable")), ["syllable"]).where("syllable is not null")
    w = Window.partitionBy("recording", "block").orderBy("frame")
    rows = rows.withColumn("_before", F.lag("syllable").over(w)).where("_before is null or _before <> syllable").withColumn("_i", F.row_number().over(w))
    entry, by = F.struct("frame", "syllable"), ["recording", "block"]
    syllables = lambda r: F.transform(r, lambda x: x["syllable"])
    blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("r")).select(*by, syllables("r").alias("s"))  # at most BLOCK rows
    # windows over recordings see one narrow row per block, never the block's entries
    order = Window.partitionBy("recording").orderBy("block")
    ends = rows.groupBy(*by).agg(F.min_by("syllable", "frame").alias("first"), F.max_by("syllable", "frame").alias("last"), F.array_sort(F.collect_list(F.when(F.col("_i") <= ahead + 1, entry))).alias("head"), F.count(F.lit(1)).alias("size"))
    ends = ends.withColumns({"again": F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)), "head": syllables("head")})  # again: goes on from the block before
    ends = ends.where(~F.col("again") | (F.col("size") > 1)).withColumn("head", F.when(F.col("again"), F.slice("head", 2, ahead)).otherwise(F.slice("head", 1, ahead)))
    heads = [F.coalesce(F.lead("head", i).over(order), F.array().cast("array<int>")) for i in range(1, ahead + 1)]
    ends = ends.select(F.col("recording").alias("_r"), F.col("block").alias("_b"), "again", F.slice(F.concat(*heads), 1, ahead).alias("after"))
    blocks = blocks.join(ends, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")))
    blocks = blocks.select("recording", F.when(F.col("again"), F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))).otherwise(F.col("s")).alias("s"), "after")
    full = blocks.withColumn("all", F.concat("s", "after"))
    return full.select("recording", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.slice("all", i, F.lit(ahead + 1)))).alias("suffix"))


def frequent_patterns(results: DataFrame, length: int = 4, gap: int = 2, least: int = 3, share: float = 0.1) -> DataFrame:
    """Ordered patterns of ``length`` pairwise different syllables with their support.

    Columns s1..s<length>, support (recordings it occurs in). Between one step and the next lie at
    most ``gap`` other entries. A pattern is frequent in at least ``least`` recordings and at least
    ``share`` of all recordings of ``results`` (those without any syllable included).

    Null syllables take no part; rows without recording or frame are left out; of repeated rows the
    latest ``loaded_at`` counts; an empty table gives no rows; extra columns are ignored.
    """
    ahead = (length - 1) * (gap + 1)
    total = results.where("recording is not null").select(F.countDistinct("recording").alias("_total"))
    floor = total.select(F.greatest(F.lit(least).cast("double"), F.ceil(F.col("_total") * share - 1e-9).cast("double")).alias("_least"))
    names = [f"s{i}" for i in range(1, length + 1)]
    grown = entries(results, ahead).select("recording", F.element_at("suffix", 1).alias("s1"), F.lit(1).alias("at"), "suffix")
    for step in range(2, length + 1):
        have = names[: step - 1]
        reach = F.sequence(F.col("at") + 1, F.least(F.col("at") + gap + 1, F.size("suffix")))
        places = F.when(F.col("at") < F.size("suffix"), F.filter(reach, lambda p: ~F.array_contains(F.array(*have), F.element_at("suffix", p))))
        grown = grown.select("recording", *have, "suffix", F.explode(places).alias("at")).select("recording", *have, F.element_at("suffix", F.col("at")).alias(names[step - 1]), "at", "suffix")
        now = names[:step]
        support = grown.select(*now, "recording").distinct().groupBy(*now).agg(F.count(F.lit(1)).alias("support"))
        frequent = support.crossJoin(F.broadcast(floor)).where("support >= _least").drop("_least")  # floor is one row
        if step == length:
            return frequent
        grown = grown.join(frequent.drop("support"), now, "left_semi")
    return grown
