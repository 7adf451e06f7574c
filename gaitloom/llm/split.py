"""Splitting oversized recordings at natural boundaries (problem 1).

Plan. Frames shrink to stretches of consecutive frames inside time blocks (one exchange); their
places in the recording come from per-block counts. Each oversized recording is laid out in chunks
of ``CHUNK_PIECES`` maximal pieces; the border between two chunks is put at the longest pause near
it, which is a cut the optimum would nearly always make as well. Dynamic programming then finds the
best cuts of each chunk, so no task holds more than one chunk of a recording.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.session import spread
from gaitloom.tables import by_block, in_force

#: Maximal pieces per chunk of one recording.
CHUNK_PIECES = 64
#: Cost of an end or a start inside a movement; at a single absent frame; of any piece; of uneven lengths.
INSIDE, SINGLE, PIECE, UNEVEN = 1.0, 0.3, 0.05, 0.2
SCHEMA = "profile string, recording string, chunk int, local int, first_frame int, last_frame int, n_frames int, natural_start boolean, natural_end boolean"


def oversized(frames: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches, recordings): runs of consecutive visible or invisible frames, and what exceeds a profile's limit."""
    sees = F.exists("pose", lambda p: F.exists(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = by_block(frames.select("recording", "frame", "loaded_at", F.coalesce(sees, F.lit(False)).alias("seen")))
    rows = in_force(rows, ["seen"])
    w = Window.partitionBy("recording", "block").orderBy("frame")
    new = (F.col("frame") - F.lag("frame").over(w) != 1) | (F.col("seen") != F.lag("seen").over(w))
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).groupBy("recording", "block", "_run").agg(F.min("frame").alias("f0"), F.count(F.lit(1)).cast("int").alias("n"), F.first("seen").alias("seen"))
    inside = Window.partitionBy("recording", "block").orderBy("f0").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = rows.groupBy("recording", "block").agg(F.sum("n").alias("_n"))
    order = Window.partitionBy("recording").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("recording").alias("_r"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy("recording")).alias("total"))
    runs = rows.join(blocks, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b"))).select("recording", "f0", "n", "seen", (F.col("_offset") + F.col("_before")).alias("i0"), "total")
    limits = limits.where("profile is not null and max_frames is not null").select(
        "profile", "max_frames", F.greatest(F.least(F.coalesce("overlap_frames", F.lit(0)), F.col("max_frames") - 1), F.lit(0)).alias("overlap"), F.coalesce("min_frames", F.lit(1)).alias("least")
    ).dropDuplicates(["profile"])
    big = runs.join(F.broadcast(limits), F.col("total") > F.col("max_frames"))  # split_limits is a fixed table of profiles
    return big, blocks.select(F.col("_r").alias("recording"), "total").distinct()


def cuts(i0: np.ndarray, n: np.ndarray, f0: np.ndarray, seen: np.ndarray, most: int, overlap: int, least: int) -> tuple[np.ndarray, list[tuple[int, int, bool, bool]]]:
    """Best pieces of consecutive stretches: (frame of every place, [(start, end, natural start, natural end)]).

    Places are counted from 0 over the given stretches. The cost of a piece that ends at place e, its
    successor starting ``overlap`` places earlier, is that of both borders; a pause costs nothing.
    """
    frame = np.repeat(f0 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    vis = np.repeat(seen, n)
    size = len(frame)
    gap = np.diff(frame) - 1
    pause = np.where((gap >= 2) | ~vis[1:] | ~vis[:-1], 0.0, np.where(gap == 1, SINGLE, INSIDE))  # between place i and i+1
    end = np.r_[pause, 0.0]
    start = np.r_[0.0, pause]
    if size <= most:
        return frame, [(0, size - 1, True, True)]
    low = min(max(least, overlap + 1), most)
    pieces = max(1, -(-(size - overlap) // (most - overlap)))
    target = (size - overlap) / pieces + overlap
    lengths = np.arange(low, most + 1)
    shape = PIECE + UNEVEN * ((lengths - target) / most) ** 2
    cost = np.full(size, np.inf)
    back = np.full(size, -1)
    here = end.copy()
    here[:-1] += start[np.maximum(np.arange(1, size) - overlap, 0)]  # start of the piece after the one ending at e
    for e in range(low - 1, size):
        a, b = e - most + overlap, e - low + overlap  # previous piece's end
        best, prev = np.inf, -1
        if e + 1 <= most:
            best = PIECE + UNEVEN * ((e + 1 - target) / most) ** 2
        lo = max(a, low - 1)
        if b >= lo:
            c = cost[lo : b + 1] + shape[: b - lo + 1][::-1]
            j = int(c.argmin())
            if c[j] < best:
                best, prev = c[j], lo + j
        cost[e], back[e] = best + here[e], prev
    out, e = [], size - 1
    if not np.isfinite(cost[e]):  # no division keeps the minimum: equal pieces, the last may be short
        s = 0
        while True:
            e = min(s + most - 1, size - 1)
            out.append((s, e, s == 0 or start[s] < INSIDE, e == size - 1 or end[e] < INSIDE))
            if e == size - 1:
                return frame, out
            s = e - overlap + 1
    while e >= 0:
        p = back[e]
        s = 0 if p < 0 else p - overlap + 1
        out.append((int(s), int(e), bool(start[s] < INSIDE), bool(end[e] < INSIDE)))
        e = p if p >= 0 else -1
    return frame, out[::-1]


def _pieces(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    profile, recording, chunk = key
    g = g.sort_values("i0")
    most, overlap, least = int(g.max_frames.iloc[0]), int(g.overlap.iloc[0]), int(g.least.iloc[0])
    lo, hi = int(g.lo.iloc[0]), int(g.hi.iloc[0])  # places of the chunk, both included
    i0, n, f0 = g.i0.to_numpy(np.int64), g.n.to_numpy(np.int64), g.f0.to_numpy(np.int64)
    skip = np.maximum(lo - i0, 0)
    i0, f0, n = i0 + skip, f0 + skip, np.minimum(n - skip, hi - (i0 + skip) + 1)
    keep = n > 0
    i0, f0, n, seen = i0[keep], f0[keep], n[keep], g.seen.to_numpy(bool)[keep]
    frame, found = cuts(i0, n, f0, seen, most, overlap, least)
    return pd.DataFrame([(profile, recording, chunk, j, int(frame[s]), int(frame[e]), e - s + 1, ns, ne) for j, (s, e, ns, ne) in enumerate(found)], columns=[c.split()[0] for c in SCHEMA.split(", ")])


def split_recordings(frames: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every recording longer than a profile allows.

    Columns: profile, recording, piece (from 0), first_frame, last_frame, n_frames, natural_start,
    natural_end. Pieces have at most ``max_frames`` and, wherever a division exists, at least
    ``min_frames`` frames; consecutive ones share exactly ``overlap_frames`` frames; every frame is in
    a piece. A recording within the limit gives no row. A pause is two or more absent frames or a
    stretch in which no keypoint is seen; a single absent frame is the next best place.

    Nulls: rows without recording or frame are left out, a null pose is a frame in which nothing is
    seen, a profile without ``max_frames`` is ignored, a null overlap is 0 and a null minimum 1.
    Repeated frames count once, the latest ``loaded_at`` tells what is seen. Ties between equally
    good divisions fall to the earlier place. Empty tables give no rows; extra columns are ignored.
    """
    runs, _ = oversized(frames, limits)
    size = F.col("max_frames") * CHUNK_PIECES
    key = ["profile", "recording"]
    # borders between chunks: the longest pause among the last max_frames places before the nominal border
    after = Window.partitionBy("profile", "recording", F.floor(F.col("i0") / size)).orderBy("i0")
    ends = runs.withColumn("c", F.floor((F.col("i0") + F.col("n") - 1 + F.col("max_frames")) / size)).withColumn("e", F.col("i0") + F.col("n") - 1)
    gap = F.coalesce(F.lead("f0").over(after) - F.col("f0") - F.col("n"), F.lit(0))
    ends = ends.withColumn("gap", F.when(F.col("seen"), gap).otherwise(F.greatest(gap, F.lit(2))))
    natural = ends.where((F.col("c") >= 1) & (F.col("e") < F.col("c") * size) & (F.col("gap") >= 1)).groupBy(*key, "c").agg(F.max(F.struct("gap", "e")).alias("g")).select(*key, "c", F.col("g.e").alias("at"))
    whole = runs.groupBy(*key).agg(F.first("total").alias("total"), F.first("max_frames").alias("max_frames"), F.first("overlap").alias("overlap"), F.first("least").alias("least"))
    last = F.greatest(F.floor((F.col("total") - F.col("max_frames")) / (F.col("max_frames") * CHUNK_PIECES)), F.lit(0))
    borders = whole.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("c")).join(natural, [*key, "c"], "left")
    borders = borders.withColumn("lo0", F.when(F.col("c") == 0, F.lit(0)).otherwise(F.coalesce("at", F.col("c") * size - 1) - F.col("overlap") + 1)).withColumn("last", last)
    nxt = F.lead(F.col("lo0") + F.col("overlap") - 1).over(Window.partitionBy(*key).orderBy("c"))
    borders = borders.select(*key, F.col("c").alias("chunk"), F.col("lo0").alias("lo"), F.coalesce(nxt, F.col("total") - 1).alias("hi"))
    # a stretch goes to every chunk it may touch (blocks bound its length)
    first, final = F.floor(F.col("i0") / size) - 1, F.floor((F.col("i0") + F.col("n") + F.col("max_frames")) / size)
    laid = runs.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), final)))
    parts = laid.join(borders, [*key, "chunk"]).where((F.col("i0") <= F.col("hi")) & (F.col("i0") + F.col("n") > F.col("lo")))
    parts = parts.select(*key, F.col("chunk").cast("int").alias("chunk"), "i0", "n", "f0", "seen", "max_frames", "overlap", "least", "lo", "hi")
    found = spread(parts, *key, "chunk").groupBy(*key, "chunk").applyInPandas(_pieces, SCHEMA)
    order = Window.partitionBy(*key).orderBy("chunk", "local")  # at most 2**32 / (max_frames - overlap) pieces
    return found.select(*key, (F.row_number().over(order) - 1).alias("piece"), "first_frame", "last_frame", "n_frames", "natural_start", "natural_end")
