"""Filters, interpolation, outliers and body geometry along time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.operators.timeline import chunked, course, mirrored, positions
from gaitloom.session import durable


def _framed(rows: DataFrame, radius: int, exprs: dict[str, Column]) -> DataFrame:
    """Columns over windows of rows -radius..radius with reflected ends, for the real rows."""
    m = chunked(mirrored(rows, radius), radius, radius)
    return m.select("*", *[e.alias(n) for n, e in exprs.items()]).where("own and pos = real").drop("own", "chunk", "real")


def median_filter(rows: DataFrame, column: str, size: int = 9, out: str = "filtered") -> DataFrame:
    """Running median of odd ``size`` with reflected ends."""
    r = size // 2
    return _framed(rows, r, {out: F.percentile(column, F.lit(0.5)).over(course().rowsBetween(-r, r))})


def upper_median_filter(rows: DataFrame, column: str, size: int, out: str = "filtered") -> DataFrame:
    """Running median of even ``size`` over rows -size/2..size/2-1, the upper of the middle two."""
    r = size // 2
    pick = F.element_at(F.array_sort(F.collect_list(column).over(course().rowsBetween(-r, r - 1))), r + 1)
    return _framed(rows, r, {out: pick})


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _weighted(column: Column, weights: list[float], w) -> Column:
    r = len(weights) // 2
    held = F.collect_list(column).over(w.rowsBetween(-r, r))
    return F.aggregate(F.zip_with(held, F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def gaussian_filter(rows: DataFrame, column: str, sigma: float, out: str = "filtered") -> DataFrame:
    """Gaussian smoothing, cut off at 4 sigma, reflected ends."""
    weights = gaussian_weights(sigma)
    return _framed(rows, len(weights) // 2, {out: _weighted(F.coalesce(F.col(column), F.lit(0.0)), weights, course())})


def gaussian_angle(rows: DataFrame, column: str, sigma: float, out: str = "filtered") -> DataFrame:
    """An angle smoothed through its sine and cosine; null angles count as 0."""
    weights, w = gaussian_weights(sigma), course()
    a = F.coalesce(F.col(column), F.lit(0.0))
    return _framed(rows, len(weights) // 2, {out: F.atan2(_weighted(F.sin(a), weights, w), _weighted(F.cos(a), weights, w))})


def median_angle(rows: DataFrame, column: str, size: int = 9, out: str = "filtered") -> DataFrame:
    """An angle median-filtered through its sine and cosine; null angles count as 0."""
    r, a = size // 2, F.coalesce(F.col(column), F.lit(0.0))
    w = course().rowsBetween(-r, r)
    return _framed(rows, r, {out: F.atan2(F.percentile(F.sin(a), F.lit(0.5)).over(w), F.percentile(F.cos(a), F.lit(0.5)).over(w))})


def body_frame(rows: DataFrame, size: int = 9) -> DataFrame:
    """Centroid and heading median-filtered over odd ``size`` in one pass, ends reflected: adds fx, fy, fh.

    ``rows``: recording, pos, n, cx, cy, heading. Null headings count as 0, null centroids are left out.
    """
    r, a = size // 2, F.coalesce(F.col("heading"), F.lit(0.0))
    w = course().rowsBetween(-r, r)
    mid = lambda c: F.percentile(c, F.lit(0.5)).over(w)
    return _framed(rows, r, {"fx": mid("cx"), "fy": mid("cy"), "fh": F.atan2(mid(F.sin(a)), mid(F.cos(a)))})


def filtered_derivative(rows: DataFrame, column: str, k: int, out: str = "derivative") -> DataFrame:
    """Mean of the next k rows less the mean of the k before, both with the row itself over k + 1, reflected ends."""
    w = course()
    return _framed(rows, k, {out: (F.sum(column).over(w.rowsBetween(0, k)) - F.sum(column).over(w.rowsBetween(-k, 0))) / (k + 1)})


def cyclic_permute(rows: DataFrame, column: str, seed: int, out: str = "permuted") -> DataFrame:
    """Each recording's column rolled by an offset drawn from its name."""
    off = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("recording"))), 1, 8), 16, 10).cast("bigint")
    src = rows.select(F.col("recording").alias("_r"), F.pmod(F.col("pos") + off, F.col("n")).alias("_p"), F.col(column).alias(out))
    return rows.join(src, (F.col("recording") == F.col("_r")) & (F.col("pos") == F.col("_p"))).drop("_r", "_p")


def keypoints(frames: DataFrame) -> DataFrame:
    """Long form of frames in force: recording, block, frame, kp, x, y, conf; NaN becomes null."""
    from gaitloom.tables import by_block, in_force

    rows = in_force(by_block(frames.select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"])
    z = rows.select("recording", "block", "frame", F.posexplode_outer(F.arrays_zip(F.coalesce("pose", F.expr("array_repeat(cast(null as array<double>), size(conf))")), F.coalesce("conf", F.expr("array_repeat(cast(null as double), size(pose))")))).alias("kp", "c"))
    f = lambda v: F.when(~F.isnan(v), v)
    a, b = z["c"].getField("0"), z["c"].getField("1")
    return z.where("kp is not null").select("recording", "block", "frame", "kp", f(F.get(a, F.lit(0))).alias("x"), f(F.get(a, F.lit(1))).alias("y"), f(b).alias("conf"))


def interpolate(points: DataFrame, reach: int | None = None) -> DataFrame:
    """x and y filled linearly over missing frames of each (recording, kp); ends take the nearest value, nothing at all gives 0.

    A cell is missing if either coordinate is. Stretches over a block's edge take their ends from one
    row per block.
    """
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    v = F.when(there, F.struct("frame", "x", "y"))
    rows = points.withColumn("_v", v)
    up = Window.partitionBy("recording", "block", "kp").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("recording", "block", "kp").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.last("_v", True).over(up)).withColumn("_n", F.last("_v", True).over(down))
    ends = rows.groupBy("recording", "block", "kp").agg(F.min("_v").alias("f"), F.max("_v").alias("l"))
    back = Window.partitionBy("recording", "kp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("recording", "kp").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("recording").alias("_r"), F.col("block").alias("_b"), F.col("kp").alias("_k"), F.last("l", True).over(back).alias("_bp"), F.last("f", True).over(ahead).alias("_an"))
    rows = rows.join(ends, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")) & (F.col("kp") == F.col("_k")))
    rows = rows.withColumn("_p", F.coalesce("_p", "_bp")).withColumn("_n", F.coalesce("_n", "_an"))
    t = (F.col("frame") - F.col("_p.frame")) / (F.col("_n.frame") - F.col("_p.frame"))
    line = lambda c: F.when(there, F.col(c)).when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * t).otherwise(F.coalesce(f"_p.{c}", f"_n.{c}", F.lit(0.0)))
    return rows.select("recording", "block", "frame", "kp", line("x").alias("x"), line("y").alias("y"), "conf", (~there).alias("filled"))


def poses(frames: DataFrame) -> DataFrame:
    """Frames in force with their keypoints in the row: recording, block, frame, x, y, conf (arrays; NaN becomes null)."""
    from gaitloom.tables import by_block, in_force

    rows = in_force(by_block(frames.select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"]).where("pose is not null or conf is not null")
    plain = lambda v: F.when(~F.isnan(v), v)
    blank = lambda other: F.expr(f"array_repeat(cast(null as double), size({other}))")
    axis = lambda i: F.coalesce(F.transform("pose", lambda p: plain(F.get(p, F.lit(i)))), blank("conf"))
    return rows.select("recording", "block", "frame", axis(0).alias("x"), axis(1).alias("y"), F.coalesce(F.transform("conf", plain), blank("pose")).alias("conf"))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs: the planner would write it out at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def middle_of(values: Column | str) -> Column:
    """Median of an array's values, nulls left out; null if there are none."""
    at = lambda s, shift: F.get(s, F.floor((F.size(s) + shift) / 2).cast("int"))
    return once(F.sort_array(F.filter(values, lambda v: v.isNotNull())), lambda s: (at(s, -1) + at(s, 0)) / 2)


def centroid_heading(rows: DataFrame, anterior: list[int], posterior: list[int]) -> DataFrame:
    """Per frame of :func:`poses`: median over keypoints, and the direction from the mean of ``posterior`` to that of ``anterior`` in [0, 2 pi].

    All inside the row; means leave missing keypoints out.
    """

    def mean(c: str, ks: list[int]) -> Column:
        v = F.filter(F.array(*[F.get(c, F.lit(k)) for k in ks]), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))

    (ax, ay), (bx, by_) = [(mean("x", k), mean("y", k)) for k in (anterior, posterior)]
    return rows.select("recording", "block", "frame", middle_of("x").alias("cx"), middle_of("y").alias("cy"), (F.atan2(by_ - ay, bx - ax) + F.pi()).alias("heading"))


def grouped_median(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Exact median per group without gathering a group.

    Values are counted in bins of about two per cent; only the values of the bins that hold the
    middle ranks are ranked, each bin on its own, equal values being counted first.
    """
    size = F.floor(F.ln(F.abs(value) + 1e-6) * 50) + 1000
    bins = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.when(F.col(value) < 0, -size).otherwise(size).alias("_bin"))
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # bins: bounded by the range of doubles
    per = bins.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("_below", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    hit = per.where((F.col("_below") < hi) & (F.col("_below") + F.col("_c") >= lo)).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bin").alias("_hit"), "_below", "_n")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by], F.col("_bin") == F.col("_hit"))
    equal = bins.join(hit, same).groupBy(*by, "_bin", "_below", "_n", "_v").agg(F.count(F.lit(1)).alias("_m"))  # tied values become one row
    upto = F.col("_below") + F.sum("_m").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = equal.withColumn("_upto", upto)
    return ranked.where((F.col("_upto") >= lo) & (F.col("_upto") - F.col("_m") < hi)).groupBy(*by).agg(F.avg("_v").alias(out))


def medoid_outliers(rows: DataFrame, scale: float = 6.0) -> DataFrame:
    """Cells farther from the frame's medoid than median + scale * MAD over the recording, per keypoint.

    ``rows`` are those of :func:`poses`. recording, block, frame, kp, x, y, conf, distance, outlier.
    Missing cells are no outliers and do not disturb the others'. Distances are taken inside the
    row; medians and bounds come back to the rows by (recording, block), so no recording is one key.
    """
    square = lambda v: v * v
    far = once(F.struct(middle_of("x").alias("x"), middle_of("y").alias("y")), lambda m: F.zip_with("x", "y", lambda x, y: F.sqrt(square(x - m["x"]) + square(y - m["y"]))))
    d = durable(rows.select("recording", "block", far.alias("d")))  # distances alone, as four passes read them
    places = durable(d.select("recording", "block").distinct())

    def back(to: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """``value`` per (recording, kp) as a map in every row of the recording."""
        per = values.groupBy("recording").agg(F.map_from_entries(F.collect_list(F.struct("kp", value))).alias(value))  # one entry a keypoint
        per = places.join(per, "recording").select(F.col("recording").alias("_r"), F.col("block").alias("_b"), value).hint("shuffle_hash")
        return to.join(per, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")), "left").drop("_r", "_b")

    each = lambda t, c, name: t.select("recording", F.posexplode(c).alias("kp", name))
    med = durable(grouped_median(each(d, "d", "distance"), ["recording", "kp"], "distance", "_med"))
    off = F.transform("d", lambda v, i: F.abs(v - F.try_element_at("_med", i)))
    mad = grouped_median(each(back(d, med, "_med"), off, "off"), ["recording", "kp"], "off", "_mad")
    e = back(rows.withColumn("d", far), med.join(mad, ["recording", "kp"]).select("recording", "kp", F.struct("_med", "_mad").alias("_mm")), "_mm")
    z = e.select("recording", "block", "frame", "_mm", F.posexplode(F.arrays_zip("x", "y", "conf", "d")).alias("kp", "z"))
    bound = once(F.try_element_at("_mm", F.col("kp")), lambda b: b["_med"] + scale * b["_mad"])
    return z.select("recording", "block", "frame", "kp", "z.x", "z.y", "z.conf", F.col("z.d").alias("distance"), F.coalesce(F.col("z.d") > bound, F.lit(False)).alias("outlier"))


def remove_outliers(rows: DataFrame, scale: float = 6.0) -> DataFrame:
    """Outliers of :func:`medoid_outliers` interpolated and their confidence set to 0."""
    o = medoid_outliers(rows, scale)
    blank = o.select("recording", "block", "frame", "kp", F.when(~F.col("outlier"), F.col("x")).alias("x"), F.when(~F.col("outlier"), F.col("y")).alias("y"), F.when(F.col("outlier"), F.lit(0.0)).otherwise(F.col("conf")).alias("conf"))
    return interpolate(blank)


def sigmasq_loc(centroids: DataFrame, size: int = 30) -> DataFrame:
    """One row: the squared mean step of the median-filtered centroid (an even filter takes the upper middle)."""
    rows = upper_median_filter(positions(centroids), "cx", size, "fx")
    rows = upper_median_filter(rows.drop("real"), "cy", size, "fy")
    w = course()
    step = F.sqrt(F.pow(F.col("fx") - F.lag("fx").over(w), 2) + F.pow(F.col("fy") - F.lag("fy").over(w), 2))
    return chunked(rows, 1, 0).withColumn("step", step).where("own").agg(F.pow(F.avg("step"), 2).alias("sigmasq_loc"))


def clean_confidence(points: DataFrame, pseudocount: float = 0.001) -> DataFrame:
    """Missing and negative confidences become 0, then the pseudocount is added."""
    return points.withColumn("conf", F.greatest(F.coalesce("conf", F.lit(0.0)), F.lit(0.0)) + pseudocount)


def confidence_bins(points: DataFrame, bins: int = 10, pseudocount: float = 0.001) -> DataFrame:
    """kp, bin, n: cells per logarithmic bin between the least and the largest confidence, the last bin closed."""
    c = points.where("conf is not null and conf >= 0").withColumn("c", F.log10(F.col("conf") + pseudocount))
    span = c.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    b = F.least(F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return c.crossJoin(F.broadcast(span)).groupBy("kp", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # span is one row

