"""Per-frame kinematics, per-syllable statistics and their ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.operators.signal import gaussian_angle
from gaitloom.operators.timeline import chunked, course
from gaitloom.session import durable

STATS = ["mean", "std", "min", "max"]


def velocity(rows: DataFrame, fps: float = 30.0, dims: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """Adds ``velocity``: centroid step times fps, 0 in a recording's first row."""
    w = course()
    step = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lag(c).over(w), 2) for c in dims]))
    return chunked(rows, 1, 0).withColumn("velocity", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(step * fps)).where("own").drop("own", "chunk")


def angular_velocity(rows: DataFrame, fps: float = 30.0, sigma: int = 3, smooth: bool = True) -> DataFrame:
    """Adds ``angular_velocity``: difference of the smoothed heading times fps, not unwrapped, 0 in the first row."""
    w = course()
    r = gaussian_angle(rows, "heading", sigma).withColumnRenamed("filtered", "_h") if smooth else rows.withColumn("_h", F.col("heading"))
    step = (F.col("_h") - F.lag("_h").over(w)) * fps
    return chunked(r, 1, 0).withColumn("angular_velocity", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(step)).where("own").drop("own", "chunk", "_h")


def frame_table(rows: DataFrame, groups: DataFrame, fps: float = 30.0) -> DataFrame:
    """name, group, frame_index, syllable, centroid, heading, angular_velocity, velocity, onset per frame."""
    w = course()
    r = angular_velocity(velocity(rows, fps), fps)
    r = chunked(r, 1, 0).withColumn("onset", F.coalesce(F.col("syllable") != F.lag("syllable").over(w), F.lit(True))).where("own")
    g = groups.select(F.col("recording").alias("_r"), "group_name")
    out = r.join(g, F.col("recording") == F.col("_r"), "left")
    return out.select(F.col("recording").alias("name"), F.coalesce("group_name", F.lit("default")).alias("group"), F.col("pos").alias("frame_index"), "syllable", "cx", "cy", "heading", "angular_velocity", "velocity", "onset")


def kinematic_stats(table: DataFrame, by: list[str], columns: tuple[str, ...] = ("heading", "angular_velocity", "velocity")) -> DataFrame:
    """mean, std (sample), min and max of the kinematic columns by ``by`` and syllable."""
    f = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return table.groupBy(*by, "syllable").agg(*[f[s](c).alias(f"{c}_{s}") for c in columns for s in STATS])


def mean_duration(run_rows: DataFrame, by: list[str], fps: float = 30.0) -> DataFrame:
    """Mean run length in seconds by ``by`` and syllable."""
    return run_rows.groupBy(*by, "syllable").agg((F.avg(F.col("end") - F.col("start")) / fps).alias("duration"))


def stats_table(table: DataFrame, run_rows: DataFrame, usage: DataFrame, min_frequency: float = 0.005, fps: float = 30.0) -> DataFrame:
    """Kinematics, frequency and duration per (group, name, syllable) of syllables used more than ``min_frequency``."""
    keep = usage.where(F.col("frequency") > min_frequency).select("syllable")
    kin = kinematic_stats(table.join(keep, "syllable", "left_semi"), ["group", "name"])
    n = run_rows.groupBy(F.col("recording").alias("name"), "syllable").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("end") - F.col("start")) / fps).alias("duration"))
    n = n.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("name"))).drop("n")  # one row per label
    return kin.join(n, ["name", "syllable"])


def order_by_stat(stats: DataFrame, stat: str = "frequency") -> DataFrame:
    """(syllable, value, rank) by falling mean of ``stat``; by label if that is the frequency, labels being in its order."""
    m = stats.groupBy("syllable").agg(F.avg(stat).alias("value"))
    w = Window.partitionBy().orderBy("syllable") if stat == "frequency" else Window.partitionBy().orderBy(F.desc(F.round("value", 9)), "syllable")  # one row per label
    return m.select("syllable", "value", (F.row_number().over(w) - 1).alias("rank"))


def order_by_difference(stats: DataFrame, stat: str, control: str, experiment: str) -> DataFrame:
    """(syllable, difference, rank): mean of ``experiment`` less that of ``control``, falling."""
    mean = lambda g: F.avg(F.when(F.col("group") == g, F.col(stat)))
    m = stats.groupBy("syllable").agg((mean(experiment) - mean(control)).alias("difference")).where("difference is not null")
    return m.select("syllable", "difference", (F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("difference", 9)), "syllable")) - 1).alias("rank"))  # one row per label


def dense_pivot(stats: DataFrame, stat: str) -> DataFrame:
    """The (group, name) x syllable table of ``stat`` in long form, 0 where absent. ``stats``, a row per recording and label, is written once, as it is used three times."""
    stats = durable(stats.select("group", "name", "syllable", stat))
    labels = stats.select("syllable").distinct()
    return stats.select("group", "name").distinct().join(F.broadcast(labels), how="cross").join(stats.select("group", "name", "syllable", F.col(stat).alias("value")), ["group", "name", "syllable"], "left").na.fill({"value": 0.0})  # labels: the model's fixed set


def bootstrap_interval(stats: DataFrame, stat: str, replicates: int = 200, level: float = 0.68, seed: int = 0) -> DataFrame:
    """group, syllable, low, high: percentile interval of the mean over resampled recordings.

    Each recording enters a replicate as often as a hash of (seed, replicate, name) says, about a
    Poisson count of mean 1, so replicates are sums and nothing is gathered.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("rep").cast("string"), "name")), 1, 8), 16, 10).cast("double") / 2**32
    poisson = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]  # cumulative, mean 1
    times = reduce(lambda a, c: a + c, [(u >= c).cast("int") for c in poisson])
    rows = stats.select("group", "name", "syllable", F.col(stat).alias("v")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", times)
    means = rows.groupBy("group", "syllable", "rep").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    a = (1 - level) / 2
    return means.groupBy("group", "syllable").agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))
