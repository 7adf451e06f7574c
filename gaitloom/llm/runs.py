"""Collapsing repeated consecutive events (problem 5).

Plan. Rows in force are hashed once by (recording, time block). Inside a block each behaviour's rows
are compared with their predecessor, change flags are summed to run identifiers and runs aggregated.
Only pieces of runs that lie at a block's edge are stitched across blocks (at most a handful per
block), and a run is dropped if another one encloses it, which its own block can tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.tables import BLOCK, by_block, in_force

#: Frame numbers that may lie between two rows of one run.
GAP = 2


def behaviour(syllables: DataFrame, info: DataFrame) -> DataFrame:
    """(syllable, behaviour): ids whose labels agree once case, blanks and punctuation are ignored are one."""
    label = F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]", "")
    names = info.where("syllable is not null").groupBy("syllable").agg(F.min(F.when(label != "", label)).alias("_label"))
    return syllables.join(names, "syllable", "left").withColumn("behaviour", F.coalesce("_label", F.concat(F.lit("#"), F.col("syllable").cast("string")))).drop("_label")


def collapse_runs(results: DataFrame, info: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per run: recording, behaviour, first_frame, last_frame, n_rows, duration (frames, both ends included).

    Rows of one behaviour belong to one run if at most ``gap`` frame numbers lie between one and the
    next, whatever those hold. A run inside another one's extent is no run. Null syllables form no
    runs and interrupt like any other row. Rows without recording or frame are left out; of repeated
    rows the latest ``loaded_at`` counts; empty tables give no rows; extra columns are ignored.
    """
    rows = in_force(by_block(results.select("recording", "frame", "loaded_at", "syllable")), ["syllable"]).where("syllable is not null")
    rows = behaviour(rows, info)
    w = Window.partitionBy("recording", "block", "behaviour").orderBy("frame")
    flag = F.coalesce((F.col("frame") - F.lag("frame").over(w) > gap + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", flag).withColumn("_run", F.sum("_new").over(w))
    pieces = rows.groupBy("recording", "block", "behaviour", "_run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))

    low = F.col("block") * BLOCK
    edge = (F.col("first") - low <= gap) | (low + BLOCK - 1 - F.col("last") <= gap)
    s = Window.partitionBy("recording", "behaviour").orderBy("first")
    at = pieces.where(edge)
    at = at.withColumn("_cut", F.coalesce((F.col("first") - F.lag("last").over(s) > gap + 1).cast("int"), F.lit(1))).withColumn("_id", F.sum("_cut").over(s))
    whole = Window.partitionBy("recording", "behaviour", "_id")
    at = at.select(
        F.col("recording").alias("_r"), F.col("block").alias("_b"), F.col("behaviour").alias("_h"), F.col("first").alias("_f"),
        F.min("first").over(whole).alias("run_first"), F.max("last").over(whole).alias("run_last"), F.sum("n").over(whole).alias("run_n"),
    )
    here = (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")) & (F.col("behaviour") == F.col("_h")) & (F.col("first") == F.col("_f"))
    pieces = pieces.join(at, here, "left").select(
        "recording", "block", "behaviour", "first", F.coalesce("run_first", "first").alias("run_first"), F.coalesce("run_last", "last").alias("run_last"), F.coalesce("run_n", "n").alias("n_rows")
    )
    # whatever encloses a run has a piece in the block of the run's first row
    before = Window.partitionBy("recording", "block").orderBy("run_first").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("run_last").over(before)
    out = pieces.withColumn("_reach", reach).where((F.col("first") == F.col("run_first")) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("run_last"))))
    return out.select("recording", "behaviour", F.col("run_first").alias("first_frame"), F.col("run_last").alias("last_frame"), "n_rows", (F.col("run_last") - F.col("run_first") + 1).alias("duration"))
