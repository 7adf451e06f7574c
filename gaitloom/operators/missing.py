"""Which cells of a frame table hold no usable value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitloom.session import durable
from gaitloom.tables import block_of

#: A pair is taken for the one its rig writes instead of a position if so large a share of the
#: rig's recordings and of its cells hold exactly it.
MIN_RECORDINGS, MIN_CELLS = 0.25, 0.001


def flat_pose(k: int) -> tuple[Column, Column]:
    cell = F.get(F.col("pose"), F.lit(k))
    return F.get(cell, F.lit(0)), F.get(cell, F.lit(1))


def no_nan(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def census(frames: DataFrame) -> DataFrame:
    """(recording, block, x, y, n, cells): what the frame table holds, counted in one reading of it and written once.

    One row per integral pair of a (recording, block), ``n`` being how often it occurs, and one with
    null x for the rest; ``cells`` sums up to the block's number of cells. Rows without recording
    or frame are left out.
    """
    whole = F.filter(F.coalesce("pose", F.array().cast("array<array<double>>")), lambda p: (F.get(p, F.lit(0)) == F.floor(F.get(p, F.lit(0)))) & (F.get(p, F.lit(1)) == F.floor(F.get(p, F.lit(1)))))
    rows = frames.where("recording is not null and frame is not null").select("recording", block_of().alias("block"), F.coalesce(F.size("pose"), F.lit(0)).alias("size"), F.posexplode_outer(whole).alias("i", "p"))
    return durable(
        rows.groupBy("recording", "block", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")).agg(
            F.count("p").alias("n"), F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.greatest("size", F.lit(0))).otherwise(0)).alias("cells")
        )
    )


def placeholder_pairs(counts: DataFrame, meta: DataFrame) -> list[tuple[str, float, float]]:
    """(rig, x, y) of the pair each rig writes where it has no position, from the counts of :func:`census`.

    Such a pair is integral and recurs exactly all over the rig's recordings, which no measured
    position does. Counts are over all rows; what reaches the driver is at most one row per rig of
    the fixed rig table.
    """
    place = meta.select("recording", "rig")
    per = counts.groupBy("recording", "x", "y").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells")).join(place, "recording")
    per_rig = per.groupBy("rig").agg(F.count_distinct("recording").alias("recs"), F.sum("cells").alias("cells"))
    hits = per.where("x is not null").groupBy("rig", "x", "y").agg(F.count(F.lit(1)).alias("hit"), F.sum("n").alias("n"))
    top = (
        hits.join(per_rig, "rig")
        .where((F.col("hit") >= MIN_RECORDINGS * F.col("recs")) & (F.col("n") >= MIN_CELLS * F.col("cells")) & (F.col("n") >= 3))
        .groupBy("rig")
        .agg(F.max(F.struct("hit", "n", "x", "y")).alias("t"))
        .select("rig", "t.x", "t.y")
    )
    return sorted((r.rig, r.x, r.y) for r in top.collect())


def placeholder_frame(meta: DataFrame, pairs: list[tuple[str, float, float]]) -> DataFrame:
    """``meta`` with the columns ``px, py``: the pair of the recording's rig, null where it has none."""
    small = meta.sparkSession.createDataFrame(pairs, "rig string, px double, py double")
    return meta.join(small, "rig", "left")
