"""From tracked frames to model input: cleaning, segments with context, alignment, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitloom.operators import signal
from gaitloom.operators.timeline import positions


def uniform(level: float, seed: int, *key: Column | str) -> Column:
    """Noise between -level and level that depends on seed and key only, so every run and engine draws the same."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2**32 * 2 - 1) * level


def cleaned(frames: DataFrame, use: list[int], outliers: float | None = None) -> DataFrame:
    """Keypoints ``use``, missing ones interpolated over time: recording, block, frame, x, y, conf (arrays in the order of ``use``).

    Positions come from the nearest frames that have them; a keypoint that a recording never shows is 0.
    With ``outliers``, positions so many deviations from their medoid are missing too, with confidence 0.
    """
    full = signal.interpolate(signal.keypoints(frames).where(F.col("kp").isin(use))) if outliers is None else signal.remove_outliers(signal.poses(frames), outliers)
    rows = full.groupBy("recording", "block", "frame").agg(F.map_from_entries(F.collect_list(F.struct("kp", F.struct("x", "y", "conf")))).alias("m"))  # one entry a keypoint
    at = lambda c: F.array(*[F.try_element_at("m", F.lit(k))[c] for k in use])
    return rows.select("recording", "block", "frame", at("x").alias("x"), at("y").alias("y"), at("conf").alias("conf"))


def format_data(frames: DataFrame, use: list[int], size: int, lags: int = 3, pseudocount: float = 1e-3, noise: float = 0.1, seed: int = 42, outliers: float | None = None) -> DataFrame:
    """Model input: recording, seg, pos, frame, context, x, y, conf (arrays over the keypoints ``use``).

    Missing positions are interpolated, confidences made positive, positions get a little noise.
    Rows are cut into segments of ``size`` positions; a segment starts with the last ``lags`` rows of
    the one before (``context`` true), so that autoregression loses nothing at the cuts. Rows of
    repeated frames count once, the latest ``loaded_at`` deciding; null arrays are missing keypoints.
    """
    return segmented(cleaned(frames, use, outliers), size, lags, pseudocount, noise, seed)


def segmented(rows: DataFrame, size: int, lags: int = 3, pseudocount: float = 1e-3, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """:func:`format_data` from the rows of :func:`cleaned`."""
    rows = positions(rows)
    shake = lambda c: F.transform(c, lambda v, i: v + uniform(noise, seed, "recording", "frame", i, F.lit(c)))
    rows = rows.select("recording", "frame", "pos", "n", shake("x").alias("x"), shake("y").alias("y"), F.transform("conf", lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) + pseudocount).alias("conf"))
    seg = F.floor(F.col("pos") / size)
    follows = (F.col("pos") % size >= size - lags) & ((seg + 1) * size < F.col("n"))
    rows = rows.withColumn("own", seg).withColumn("seg", F.explode(F.when(follows, F.array(seg, seg + 1)).otherwise(F.array(seg))))
    return rows.select("recording", "seg", "pos", "frame", (F.col("own") != F.col("seg")).alias("context"), "x", "y", "conf")


def unbatch(segments: DataFrame) -> DataFrame:
    """The rows of :func:`format_data` or of a model over its segments, once each: context rows left out."""
    return segments.where(~F.col("context")).drop("context", "seg")


def aligned(rows: DataFrame, anterior: list[int], posterior: list[int]) -> DataFrame:
    """Poses moved to their centroid and turned by minus their heading: recording, frame, cx, cy, heading, v (x and y in turn).

    ``rows``: recording, block, frame, x, y (arrays), ``anterior`` and ``posterior`` positions in them.
    """
    c = signal.centroid_heading(rows, anterior, posterior).select(F.col("recording").alias("_r"), F.col("block").alias("_b"), F.col("frame").alias("_f"), "cx", "cy", "heading")
    j = rows.join(c, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")) & (F.col("frame") == F.col("_f")))
    cos, sin = F.cos("heading"), F.sin("heading")
    turned = F.transform(F.arrays_zip("x", "y"), lambda z: F.array(cos * (z["x"] - F.col("cx")) + sin * (z["y"] - F.col("cy")), cos * (z["y"] - F.col("cy")) - sin * (z["x"] - F.col("cx"))))
    return j.select("recording", "frame", "cx", "cy", "heading", F.flatten(turned).alias("v"))


def moments(vectors: DataFrame, column: str, dims: int, adders: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, sums, sums of products) of a column of vectors; null vectors are left out.

    Every task reduces its Arrow batches to one dims x dims matrix, ``adders`` tasks add those up.
    """
    width = 1 + dims + dims * dims

    def reduce(batches):
        total = np.zeros(width)
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(len(b), -1)[:, :dims]
            total += np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        yield pd.DataFrame({"k": [TaskContext.get().partitionId() % adders], "s": [total.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [sum(np.frombuffer(bytes(v)) for v in g["s"]).tobytes()]})

    part = vectors.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v")).mapInPandas(reduce, "k int, s binary")
    total = sum((np.frombuffer(bytes(r.s)) for r in part.groupBy("k").applyInPandas(add, "s binary").collect()), np.zeros(width))
    return int(total[0]), total[1 : 1 + dims], total[1 + dims :].reshape(dims, dims)


@dataclass
class Pca:
    """Principal components: mean (dims), components (rank, dims), variance (rank)."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray

    def shares(self) -> np.ndarray:
        total = self.variance.sum()
        return self.variance / total if total > 0 else self.variance


def pca_fit(vectors: DataFrame, column: str, dims: int, adders: int = 64) -> Pca:
    """Exact components over all vectors. Each component's largest loading is positive, which fixes its sign."""
    return pca_of(*moments(vectors, column, dims, adders))


def pca_of(n: int, s: np.ndarray, ss: np.ndarray) -> Pca:
    """:func:`pca_fit` from the result of :func:`moments`."""
    dims = len(s)
    mean = s / max(n, 1)
    value, vector = np.linalg.eigh(ss / max(n, 1) - np.outer(mean, mean))
    comp = vector.T[::-1]
    sign = np.sign(comp[np.arange(dims), np.abs(comp).argmax(1)])
    return Pca(mean, comp * np.where(sign == 0, 1, sign)[:, None], np.maximum(value[::-1], 0))


def pca_project(vectors: DataFrame, column: str, p: Pca, rank: int, out: str = "latent") -> DataFrame:
    """Adds the first ``rank`` scores of every vector as an array; null vectors stay null. Inside the JVM."""
    score = lambda w: F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(float(-(w @ p.mean))), lambda s, v: s + v)
    return vectors.withColumn(out, F.when(F.col(column).isNotNull(), F.array(*[score(p.components[i]) for i in range(rank)])))


def pca_shapes(spark: SparkSession, p: Pca, rank: int, magnitude: float = 2.0) -> DataFrame:
    """Mean pose moved along each component by ``magnitude`` standard deviations: component, sign, kp, x, y (rank x 2 x keypoints rows)."""
    rows = []
    for i in range(rank):
        for sign in (-1, 1):
            v = p.mean + sign * magnitude * np.sqrt(p.variance[i]) * p.components[i]
            rows += [(i, sign, k, float(v[2 * k]), float(v[2 * k + 1])) for k in range(len(v) // 2)]
    return spark.createDataFrame(rows, "component int, sign int, kp int, x double, y double")


def pca_save(spark: SparkSession, p: Pca, path: str) -> None:
    rows = [(-1, None, p.mean.tolist())] + [(i, float(p.variance[i]), c.tolist()) for i, c in enumerate(p.components)]
    spark.createDataFrame(rows, "component int, variance double, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def pca_load(spark: SparkSession, path: str) -> Pca:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.component)  # one row per component
    return Pca(np.array(rows[0].v), np.array([r.v for r in rows[1:]]), np.array([r.variance for r in rows[1:]]))
