"""Implausible readings per source: isolation forests and physical limits (problem 4).

Plan. A census of the frames, written once, gives recordings, blocks and the pairs written instead
of positions. Frames are hashed once by (recording, time block), a header row with the rig's area,
pair and frame rate leading each block, so that nothing is joined to the readings. In one pass every
reading becomes a code of its features, in units of what is usual in its block; each block is
reduced to the counts of its codes and its readings that are not ordinary in every way, written
once. The counts are summed per recording (map-side first), an isolation forest over all readings of
the recording scores every code, and the readings whose code scores above ``ABOVE`` are flagged:
the forest alone decides, but for readings outside physical limits. No task holds more than one
block of a recording; the flagged codes are joined to blocks by (recording, span of blocks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitloom.operators import spike_kernel as K
from gaitloom.operators.missing import census, flat_pose, no_nan, placeholder_frame, placeholder_pairs
from gaitloom.session import durable, spread
from gaitloom.tables import BLOCK, recording_meta

#: Isolation forest: trees, their depth, and the size of the sample to which a recording's readings are scaled. So small
#: a sample keeps the many readings of a frozen stretch or of a jump of the whole animal from hiding one another.
TREES, DEPTH, SAMPLE = 128, 8, 8
#: A reading is implausible if its score lies above this (the bulk of a recording scores 0.5).
ABOVE = 0.56
#: Blocks that share one copy of their recording's flagged codes.
SPAN = 64
SCHEMA_FLAGS = "recording string, frame int, kp int, field string, reason string, score double"
BLOCKS = pa.schema([("recording", pa.string()), ("block", pa.int32()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("frames", pa.list_(pa.int32())), ("cells", pa.list_(pa.int32())), ("odd", pa.list_(pa.int32()))])


def _at(frame, shift: int = 0):
    return F.floor((frame + F.lit(shift + BLOCK // 2)) / BLOCK).cast("int")


def _blocks(frames: DataFrame, counts: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Compact rows hashed by (recording, block), each block with its header and margins, sorted for the kernel.

    A header has no frame and, in place of the pose, width, height, px, py and frames a second.
    """
    pose = F.array(*[no_nan(c).cast("float") for i in range(k) for c in flat_pose(i)])
    conf = F.array(*[no_nan(F.get("conf", F.lit(i))).cast("float") for i in range(k)])
    frame = F.col("frame")
    rows = frames.where("recording is not null and frame is not null").select(
        "recording", "frame", pose.alias("pose"), conf.alias("conf"), F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62))).alias("loaded"),
        F.explode(F.array_distinct(F.array(_at(frame), _at(frame, K.MARGIN), _at(frame, -K.MARGIN)))).alias("block"),
    )
    places = counts.select("recording", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block")).distinct()  # a block of the census lies in two of these
    heads = places.join(known, "recording").select(
        "recording", F.lit(None).cast("int").alias("frame"), F.array(*[F.col(c).cast("float") for c in ("width", "height", "px", "py", "fps")]).alias("pose"),
        F.lit(None).cast("array<float>").alias("conf"), F.lit(-(2**62)).cast("bigint").alias("loaded"), "block",
    )
    return rows.unionByName(heads).repartition("recording", "block").sortWithinPartitions("recording", "block", "frame", "loaded")


def _grouped(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], least: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Feed ``work`` tables of whole (recording, block) groups and the group number of every row."""

    def numbers(t: pa.Table) -> np.ndarray:
        rec = t.column("recording").combine_chunks().dictionary_encode()
        rec = (rec.combine_chunks() if isinstance(rec, pa.ChunkedArray) else rec).indices.to_numpy(zero_copy_only=False)
        blk = t.column("block").to_numpy()
        return np.cumsum(np.r_[False, (rec[1:] != rec[:-1]) | (blk[1:] != blk[:-1])])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        g = numbers(t)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            if (out := work(t.slice(0, cut), g[:cut])) is not None:
                yield out
            t = t.slice(cut)
        held, rows = t.combine_chunks().to_batches(), t.num_rows
    if held:
        t = pa.Table.from_batches(held)
        if (out := work(t, numbers(t))) is not None:
            yield out


def _floats(t: pa.Table, name: str, width: int) -> np.ndarray:
    v = t.column(name).combine_chunks()
    v = pa.chunked_array([v]) if isinstance(v, pa.Array) else v
    return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _in_force(t: pa.Table, g: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Rows in force: (group, frame, pose, conf); the last version of a frame wins."""
    frame = t.column("frame").to_numpy().astype(np.int64)
    order = np.arange(len(frame))
    if (np.diff(frame) < 0)[g[1:] == g[:-1]].any():
        order = np.lexsort((t.column("loaded").to_numpy(), frame, g))
        frame, g = frame[order], g[order]
    keep = np.r_[(frame[1:] != frame[:-1]) | (g[1:] != g[:-1]), True]
    return g[keep], frame[keep], _floats(t, "pose", 2 * k)[order][keep].reshape(-1, k, 2), _floats(t, "conf", k)[order][keep]


def _reduce(k: int) -> Callable:
    """Per (recording, block): counts of codes, and frame, cell and code of the readings that are not ordinary.

    cell: keypoint for a position, k + keypoint for a confidence; code -1: outside physical limits.
    """

    def work(t: pa.Table, g: np.ndarray) -> pa.RecordBatch | None:
        head = t.column("frame").is_null().to_numpy()
        side = np.full((int(g[-1]) + 1, 5), np.nan, np.float32)
        side[g[head]] = _floats(t.filter(pa.array(head)), "pose", 5)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        names, blocks = t.column("recording").take(pa.array(first)).to_pylist(), t.column("block").to_numpy()[first]
        if head.all():
            return None
        g, frame, pose, conf = _in_force(t.filter(pa.array(~head)), g[~head], k)
        width, height, px, py, fps = (side[g, i] for i in range(5))
        void = np.isnan(pose).any(2) | ((pose[..., 0] == px[:, None]) & (pose[..., 1] == py[:, None]))
        w, h = np.nan_to_num(width, nan=np.inf)[:, None], np.nan_to_num(height, nan=np.inf)[:, None]
        out_pose = ~void & ((pose < 0).any(2) | (pose[..., 0] > w) | (pose[..., 1] > h))
        out_conf = (conf < 0) | (conf > 1)
        pose[void | out_pose] = np.nan
        conf[out_conf] = np.nan
        lag = np.clip(np.rint(K.PERIOD * np.where(fps > 0, fps, K.FPS)), 1, K.MARGIN).astype(np.int64)
        code = np.concatenate(K.codes(K.features(g, frame, pose, conf, lag)), 1)
        there = ~np.isnan(np.concatenate([pose[..., 0], conf], 1))
        limit = np.concatenate([out_pose, out_conf], 1)
        own = ((frame + BLOCK // 2) // BLOCK == blocks[g])[:, None]
        out = {n: [] for n in BLOCKS.names}
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(start, np.r_[start[1:], len(g)]):
            seen, c = there[a:b] & own[a:b], code[a:b]
            u, n = np.unique(c[seen], return_counts=True)
            lim = limit[a:b] & own[a:b]
            r, cell = np.nonzero(lim | (seen & (c % K.CODES > 0)))
            if len(u) or len(r):
                for name, v in zip(out, (names[g[a]], int(blocks[g[a]]), u, n, frame[a:b][r].astype(np.int32), cell.astype(np.int32), np.where(lim[r, cell], -1, c[r, cell]).astype(np.int32))):
                    out[name].append(v)
        return pa.RecordBatch.from_pydict(out, BLOCKS)

    return lambda batches: _grouped(batches, work)


def _forest(above: float) -> Callable:
    """Per recording: the codes whose isolation score lies above ``above``, and their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = b.column("hist")
            off = hist.offsets.to_numpy()
            code, n = (hist.values.field(c).to_numpy()[off[0] : off[-1]] for c in ("code", "n"))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            distinct, inv = np.unique(code, return_inverse=True)
            leaf = K.leaves(distinct, TREES, DEPTH, 7)
            score = np.zeros(len(code))
            for rows in np.array_split(np.arange(b.num_rows), max(1, len(code) // 4000)):  # bounds the memory of a step
                m = slice(*np.searchsorted(row, [rows[0], rows[-1] + 1])) if len(rows) else slice(0, 0)
                if m.start < m.stop:
                    score[m] = K.isolation_scores(row[m] * 2 + (code[m] >= K.CODES), leaf[inv[m]], n[m], DEPTH, SAMPLE)
            hit = (score > above) & (code % K.CODES > 0)
            ends = np.searchsorted(row[hit], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("recording"), pa.ListArray.from_arrays(pa.array(ends), pa.array(code[hit].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(score[hit]))], names=["recording", "apart", "scores"])

    return run


def implausible_readings(frames: DataFrame, index: DataFrame, rigs: DataFrame, keypoints: int, above: float = ABOVE) -> DataFrame:
    """(recording, frame, kp, field, reason, score) of every reading that cannot be genuine.

    reason: 'limit' (outside the rig's area, or a confidence outside 0 to 1), 'frozen' (set apart, with
    a value repeated far longer than usual; the first reading of the stretch is genuine), 'spike' (set
    apart otherwise: departs from its course for a few frames and returns, alone or with the whole
    animal). score: the isolation score, above ``above``; 1 for a limit. Missing cells are never
    flagged. Nulls: a null pose, conf, cell or coordinate is missing; rows without recording or
    frame are left out; a recording without known rig has no area and counts as 30 frames a second.
    Repeated and corrected rows: the latest ``loaded_at`` counts. An empty table gives no rows.
    Extra columns of any input are ignored.
    """
    counts = census(frames)
    meta = recording_meta(counts, index, rigs)
    known = placeholder_frame(meta, placeholder_pairs(counts, meta)).select("recording", "width", "height", "px", "py", "fps")
    blocks = durable(_blocks(frames, counts, known, keypoints).mapInArrow(_reduce(keypoints), "recording string, block int, codes array<int>, counts array<bigint>, frames array<int>, cells array<int>, odd array<int>"))
    totals = blocks.select("recording", F.explode(F.arrays_zip("codes", "counts")).alias("z")).groupBy("recording", F.col("z.codes").alias("code")).agg(F.sum("z.counts").alias("n"))
    hist = spread(totals, "recording").groupBy("recording").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("hist"))  # at most 2 * CODES entries
    forest = hist.mapInArrow(_forest(above), "recording string, apart array<int>, scores array<double>")
    span = F.floor(F.col("block") / SPAN).alias("span")
    spans = blocks.select("recording", span).distinct().join(forest, "recording")
    odd = blocks.where(F.size("odd") > 0).select("recording", span, "frames", "cells", "odd")
    cells = odd.join(spans, ["recording", "span"], "left").select("recording", F.map_from_arrays("apart", "scores").alias("scores"), F.explode(F.arrays_zip("frames", "cells", "odd")).alias("z"))
    score = F.when(F.col("z.odd") < 0, 1.0).otherwise(F.try_element_at("scores", F.col("z.odd")))
    pose = F.col("z.cells") < keypoints
    return cells.select("recording", "z", score.alias("score")).where("score is not null").select(
        "recording", F.col("z.frames").alias("frame"), F.when(pose, F.col("z.cells")).otherwise(F.col("z.cells") - keypoints).alias("kp"),
        F.when(pose, "pose").otherwise("conf").alias("field"),
        F.when(F.col("z.odd") < 0, "limit").when(F.col("z.odd") % K.PLACES > 0, "frozen").otherwise("spike").alias("reason"), "score",
    )
