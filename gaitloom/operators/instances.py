"""Syllable instances: eligibility, windows of frames, ego-centric trajectories, sampling, similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.operators.formatting import pca_fit
from gaitloom.operators.signal import body_frame, grouped_median
from gaitloom.session import durable


def eligible(run_rows: DataFrame, pre: int = 30, post: int = 60, min_duration: int = 3, min_frequency: float = 0.0, min_instances: int = 0) -> DataFrame:
    """Runs long enough, with ``pre`` rows before and ``post`` after their start, of syllables used and seen often enough."""
    usage = run_rows.groupBy("syllable").agg(F.count(F.lit(1)).alias("_n"))
    usage = usage.withColumn("_f", F.col("_n") / F.sum("_n").over(Window.partitionBy()))  # one row per label
    ok = run_rows.where((F.col("end") - F.col("start") >= min_duration) & (F.col("start") >= pre) & (F.col("start") < F.col("n") - post))
    many = ok.groupBy("syllable").agg(F.count(F.lit(1)).alias("_i")).join(usage, "syllable").where((F.col("_i") >= min_instances) & (F.col("_f") >= min_frequency)).select("syllable")
    return ok.join(many, "syllable", "left_semi").select("recording", "syllable", "start", "end")


def windows(instances: DataFrame, pre: int, post: int) -> DataFrame:
    """One row per instance and relative position -pre..post-1: recording, syllable, start, rel, pos. An equi join key, not a range."""
    return instances.select("recording", "syllable", "start", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel")).withColumn("pos", F.col("start") + F.col("rel"))


def egocentric(instances: DataFrame, points: DataFrame, onsets: DataFrame, pre: int, post: int) -> DataFrame:
    """Keypoints around each instance, moved to the onset centroid and turned by minus the onset heading.

    ``points``: recording, pos, kp, x, y. ``onsets``: recording, pos, cx, cy, heading.
    """
    o = onsets.select("recording", F.col("pos").alias("start"), "cx", "cy", "heading")
    w = windows(instances, pre, post).join(o, ["recording", "start"])
    j = w.join(points, ["recording", "pos"])
    dx, dy, h = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("heading")
    return j.select("recording", "syllable", "start", "rel", "kp", (F.cos(h) * dx + F.sin(h) * dy).alias("x"), (F.cos(h) * dy - F.sin(h) * dx).alias("y"))


def egocentric_poses(instances: DataFrame, states: DataFrame, rows: DataFrame, pre: int, post: int, filter_size: int = 9) -> DataFrame:
    """Keypoint trajectories around each instance in the frame of its onset: recording, syllable, start, rel, x, y (arrays).

    ``states``: recording, frame, pos, n, cx, cy, heading; centroid and heading are median-filtered
    first. ``rows``: recording, frame, x, y (arrays over keypoints, as ``signal.poses``). Frames without a pose give no row,
    missing keypoints stay null.
    """
    smooth = body_frame(states, filter_size)
    onsets = smooth.select("recording", F.col("pos").alias("start"), "fx", "fy", "fh")
    placed = windows(instances, pre, post).join(onsets, ["recording", "start"]).join(states.select("recording", "frame", "pos"), ["recording", "pos"])
    j = placed.join(rows.select("recording", "frame", "x", "y"), ["recording", "frame"])  # poses, the wide rows, move once
    cos, sin = F.cos("fh"), F.sin("fh")
    turn = lambda a, b: F.transform(F.arrays_zip("x", "y"), lambda z: a(z["x"] - F.col("fx"), z["y"] - F.col("fy")) + b(z["x"] - F.col("fx"), z["y"] - F.col("fy")))
    return j.select(
        "recording", "syllable", "start", "rel",
        turn(lambda dx, dy: cos * dx, lambda dx, dy: sin * dy).alias("x"), turn(lambda dx, dy: cos * dy, lambda dx, dy: -sin * dx).alias("y"),
    )


def per_keypoint(trajectories: DataFrame) -> DataFrame:
    """Trajectories of :func:`egocentric_poses` with one row per keypoint: recording, syllable, start, rel, kp, x, y; missing ones left out."""
    z = trajectories.select("recording", "syllable", "start", "rel", F.posexplode(F.arrays_zip("x", "y")).alias("kp", "z"))
    return z.select("recording", "syllable", "start", "rel", "kp", "z.x", "z.y").where("x is not null and y is not null")


def window_size(trajectories: DataFrame, share: float = 0.9, margin: float = 1.1, block: int = 16) -> DataFrame:
    """One row, window: side of the square that shows that share of frames, with a margin, in whole blocks.

    A frame counts by its farthest keypoint along either axis, to a hundredth; counts come before the percentile.
    """
    far = lambda c: F.array_max(F.transform(c, F.abs))
    reach = trajectories.select(F.explode(F.array(far("x"), far("y"))).alias("v")).where("v is not null")
    counts = reach.groupBy(F.round("v", 2).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.ceil(F.percentile("v", F.lit(share), F.col("n")) * margin * 2 / block) * block).cast("int").alias("window"))


def whole_vectors(trajectories: DataFrame, pre: int, post: int, keypoints: int) -> DataFrame:
    """One vector per instance: id (hash of recording and start), label, recording, start, v.

    v runs over time, keypoints and both axes. A cell that is missing takes the instance's nearest
    earlier value of that keypoint, else the nearest later one; an instance that lacks a keypoint
    throughout has 0 there, the place of the centroid.
    """
    per = trajectories.groupBy("recording", "syllable", "start").agg(F.collect_list(F.struct("rel", "x", "y")).alias("m"))  # pre + post entries
    span = pre + post

    def fill(batches):
        for b in batches:
            m = b.column("m")
            at, each = np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy())), m.flatten()
            rel = each.field("rel").to_numpy(zero_copy_only=False) + pre
            v = np.zeros((len(m), keypoints, 2, span))
            for axis, c in enumerate("xy"):
                lists = pc.list_parent_indices(each.field(c)).to_numpy()
                cells, first = each.field(c).flatten(), np.searchsorted(lists, np.arange(len(rel)))
                kp, there = np.arange(len(lists)) - first[lists], cells.is_valid().to_numpy(zero_copy_only=False)
                there &= kp < keypoints
                key = at[lists[there]], kp[there], rel[lists[there]]
                raw, seen = np.zeros((len(m), keypoints, span)), np.zeros((len(m), keypoints, span), bool)
                raw[key], seen[key] = cells.to_numpy(zero_copy_only=False)[there], True
                last = np.maximum.accumulate(np.where(seen, np.arange(span), -1), 2)
                v[:, :, axis] = np.take_along_axis(raw, np.where(last < 0, seen.argmax(2)[..., None], last), 2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * (keypoints * 2 * span)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "recording", "start")), flat], ["id", "label", "recording", "start", "v"])

    keyed = per.select(F.xxhash64("recording", "start").alias("id"), F.col("syllable").alias("label"), "recording", "start", "m")
    kinds = dict(keyed.dtypes)
    return keyed.mapInArrow(fill, ", ".join(f"{c} {kinds[c]}" for c in ("id", "label", "recording", "start")) + ", v array<double>")


def typical(trajectories: DataFrame) -> DataFrame:
    """Median trajectory per syllable: syllable, rel, kp, x, y. Exact, and no syllable is gathered in one task."""
    by = ["syllable", "rel", "kp"]
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in "xy"])  # both axes in one pass
    m = grouped_median(trajectories.select(*by, F.explode(axes).alias("z")).select(*by, "z.axis", "z.v"), [*by, "axis"], "v", "v")
    return m.groupBy(*by).agg(*[F.max(F.when(F.col("axis") == c, F.col("v"))).alias(c) for c in "xy"])


def similarity(typicals: DataFrame, metric: str = "cosine") -> DataFrame:
    """Distances of all pairs of syllables by their flattened typical trajectories: a, b, distance."""
    long = typicals.select("syllable", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("x").alias("v")), F.struct(F.lit(1).alias("d"), F.col("y").alias("v")))).alias("z"), "rel", "kp").select("syllable", "rel", "kp", "z.d", "z.v")
    a, b = long.withColumnsRenamed({"syllable": "a", "v": "va"}), long.withColumnsRenamed({"syllable": "b", "v": "vb"})
    j = a.join(b, ["rel", "kp", "d"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("ab"), F.sum(F.col("va") ** 2).alias("aa"), F.sum(F.col("vb") ** 2).alias("bb"), F.sum((F.col("va") - F.col("vb")) ** 2).alias("dd"))
    d = 1 - F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))) if metric == "cosine" else F.sqrt("dd")
    return j.select("a", "b", d.alias("distance"))


def draw(rows: DataFrame, by: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows per group in the order of a hash of seed and key: the same rows wherever it runs."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    w = Window.partitionBy(*by).orderBy("_h", *key)
    return rows.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_h", "_k")


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of at most ``size`` that lie together: halves along the widest side, again and again."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        i = todo.pop()
        if len(i) <= size:
            done.append(i)
            continue
        side = x[i, np.ptp(x[i], 0).argmax()]
        o = side.argpartition(len(i) // 2)
        todo += [i[o[: len(i) // 2]], i[o[len(i) // 2 :]]]
    return done


class _Near:
    """The rows of ``b`` in leaves with their bounds, so that few of them are met by :meth:`nearest`."""

    def __init__(self, b: np.ndarray, size: int = 64):
        leaves = _leaves(b, size) if len(b) else []
        self.b, self.size, self.parts = b, size, [b[i] for i in leaves]
        self.n = np.array([len(i) for i in leaves])
        self.low, self.high = (np.array([f(x, 0) for x in self.parts]) for f in (np.min, np.max))

    def nearest(self, a: np.ndarray, k: int) -> np.ndarray:
        """For every row of ``a`` its ``k`` smallest distances to the rows, rising; fewer if there are fewer.

        Exact: a leaf is left out only if it lies farther from all rows of a part of ``a`` than ``k`` rows that were met.
        """
        k = min(k, len(self.b))
        out = np.zeros((len(a), k))
        if not len(a) or not k:
            return out
        centre = (self.low + self.high) / 2
        for i in _leaves(a, self.size):
            q = a[i]
            low, high = q.min(0), q.max(0)
            away = (np.maximum(np.maximum(self.low - high, low - self.high), 0) ** 2).sum(1)
            order = ((centre - (low + high) / 2) ** 2).sum(1).argsort(kind="stable")
            some = order[: np.searchsorted(np.cumsum(self.n[order]), 2 * k) + 1]
            reach = np.partition(self._squares(q, some), k - 1, 1)[:, k - 1].max()
            d = self._squares(q, np.flatnonzero(away <= reach * (1 + 1e-9)))
            out[i] = np.sqrt(np.sort(np.partition(d, k - 1, 1)[:, :k], 1))
        return out

    def _squares(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        b = np.concatenate([self.parts[j] for j in leaves])
        return sum((q[:, j, None] - b[None, :, j]) ** 2 for j in range(b.shape[1]))


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For every row of ``a`` its ``k`` smallest distances to rows of ``b``, rising; fewer if ``b`` has fewer."""
    return _Near(b).nearest(a, k)


def _first_by_hash(rows: DataFrame, sample: int, seed: int) -> Column:
    """Whether a row's id is among the ``sample`` first in the order of a hash of seed and id.

    Counts per beginning of the hash and the last key drawn reach the driver, never the rows.
    """
    h, cut = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), F.substring("h", 1, 3)
    keys, total = rows.select("id", h.alias("h")), 0
    for part, n in sorted(map(tuple, keys.groupBy(cut).count().collect())):  # at most 4096 rows
        total += n
        if total > sample:
            last = keys.where(cut <= part).orderBy("h", "id").limit(sample).agg(F.max(F.struct("h", "id")).alias("t")).first().t
            return F.struct(h.alias("h"), "id") <= F.struct(F.lit(last.h).alias("h"), F.lit(last.id).alias("id")) if last else F.lit(False)
    return F.lit(True)


def _densities(vectors: DataFrame, neighbours: int, dims: int, sample: int, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(points: id, label, q; scored: label, id, local, overall of every vector).

    ``vectors``: id (unique), label, v. Directions and the neighbours among all come from at most
    ``sample`` vectors drawn by hash, as in the reference; the neighbours among its own from every
    vector of the label, the vector itself included. The driver gets sums of products of the drawn
    vectors and their projections, ``dims`` numbers each. Labels are cut by hash into blocks of about
    ``block`` vectors: a task meets one pair of blocks, and a vector's nearest over the pairs are merged.
    """
    drawn = _first_by_hash(vectors, sample, seed)
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    p = pca_fit(vectors.where(drawn), "v", width, 8) if width else None
    mean, axes = (p.mean, p.components[:dims].T) if p else (np.zeros(0), np.zeros((0, 0)))

    def project(batches):
        for b in batches:
            if not len(b):
                continue
            q = (np.array(b["v"].tolist(), float).reshape(len(b), -1) - mean) @ axes
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "q": list(q)})

    points = durable(vectors.select("id", "label", "v").mapInPandas(project, "id bigint, label int, q array<double>"))
    ref = np.array([r.q for r in points.where(drawn).select("q").collect()], float)  # sample x dims numbers

    def against(batches):
        near = _Near(ref)
        for b in batches:
            if len(b):
                yield b.assign(overall=1 / np.maximum(near.nearest(np.array(b["q"].tolist(), float), neighbours).mean(1), 1e-12))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = _nearest(np.array(a["q"].tolist(), float), np.array(b["_oq"].tolist(), float), neighbours) if len(a) and len(b) else []
        return pd.DataFrame({"id": a["id"], "label": a["label"], "overall": a["overall"], "near": list(near)}) if len(near) else pd.DataFrame({"id": [], "label": [], "overall": [], "near": []})

    sizes = durable(points.groupBy(F.col("label").alias("_l")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")))
    cut = lambda rows: rows.join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("_l"))).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))  # noqa: E731  one row per label
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    scored = points.mapInPandas(against, "id bigint, label int, q array<double>, overall double")
    ask = cut(scored).select("id", "label", "q", "overall", F.col("_b").alias("i"), every.alias("j")).groupBy("label", "i", "j")
    own = cut(points).select(F.col("label").alias("_ol"), F.col("q").alias("_oq"), F.col("_b").alias("_oj"), every.alias("_oi")).groupBy("_ol", "_oi", "_oj")
    met = ask.cogroup(own).applyInPandas(meet, "id bigint, label int, overall double, near array<double>")
    merged = met.groupBy("id", "label").agg(F.first("overall").alias("overall"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near"))
    mean_near = F.aggregate("near", F.lit(0.0), lambda s, v: s + v) / F.size("near")
    return points, merged.select("id", "label", (1 / F.greatest(mean_near, F.lit(1e-12))).alias("local"), "overall")


def _densest(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.max_by(F.struct("id", "local", "overall"), F.struct(F.round(F.col("local") / F.col("overall"), 9), -F.col("id"))).alias("t")).select("label", "t.id", "t.local", "t.overall")


def density_exemplars(vectors: DataFrame, neighbours: int = 50, dims: int = 4, sample: int = 50_000, seed: int = 0, block: int = 8192) -> DataFrame:
    """Per label the vector that is densest among its own against all: label, id, local, overall. See :func:`_densities`."""
    return _densest(_densities(vectors, neighbours, dims, sample, seed, block)[1])


def density_sample(vectors: DataFrame, n: int = 50, neighbours: int = 50, dims: int = 4, sample: int = 50_000, seed: int = 0, block: int = 8192) -> DataFrame:
    """Per label the ``n`` vectors nearest to its densest one, itself included: label, id, distance.

    Distances are those in the projection. Ties fall to the smaller id; a label with fewer vectors
    gives all of them.
    """
    points, scored = _densities(vectors, neighbours, dims, sample, seed, block)
    best = _densest(scored).select(F.col("label").alias("_l"), F.col("id").alias("_id"))
    best = best.join(points.select(F.col("id").alias("_id"), F.col("q").alias("_q")), "_id")
    near = points.join(F.broadcast(best), F.col("label").eqNullSafe(F.col("_l")))  # one row per label
    near = near.select("label", "id", F.sqrt(F.aggregate(F.zip_with("q", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("distance"), F.pmod("id", F.lit(64)).alias("_salt"))
    some = near.withColumn("_k", F.row_number().over(Window.partitionBy("label", "_salt").orderBy("distance", "id"))).where(F.col("_k") <= n)  # a label may hold most vectors: nearest within slices first
    return some.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("distance", "id"))).where(F.col("_k") <= n).select("label", "id", "distance")


def typical_dense(trajectories: DataFrame, pre: int, post: int, keypoints: int, n: int = 50, **options) -> DataFrame:
    """Median trajectory per syllable over the ``n`` instances around its most exemplary one: syllable, rel, kp, x, y.

    Syllables with fewer than ``n`` instances are left out.
    """
    vectors = durable(whole_vectors(trajectories, pre, post, keypoints))
    many = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("label")
    vectors = vectors.join(F.broadcast(durable(many)), "label", "left_semi")  # one row per label
    ids = density_sample(vectors.select("id", "label", "v"), n, n, **options).select("id")
    chosen = vectors.join(F.broadcast(ids), "id", "left_semi")  # n rows per label
    long = chosen.select(F.col("label").alias("syllable"), F.posexplode("v").alias("at", "value"))
    span = pre + post
    kp, axis, rel = F.floor(F.col("at") / (2 * span)).cast("int"), F.floor(F.col("at") / span) % 2, (F.col("at") % span - pre).cast("int")
    return long.groupBy("syllable", rel.alias("rel"), kp.alias("kp")).agg(F.median(F.when(axis == 0, F.col("value"))).alias("x"), F.median(F.when(axis == 1, F.col("value"))).alias("y"))  # n instances a syllable
