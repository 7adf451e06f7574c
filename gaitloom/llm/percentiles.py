"""Percentiles of very large numeric columns from cumulative frequencies (problem 6).

A summary is a table of (group..., bin, n): how often each value occurs per group. Values become
bins of relative width 2 * ``error`` (exact for ``error`` 0), so a summary has a bounded number of
rows per group whatever the number of values, and summaries of separate days or portions are
combined by adding counts. Percentiles are read from it by cumulative frequencies: the counts are
sorted by range over the whole cluster, running sums inside a range start from the sum of the
ranges before it, and the first value that reaches a rank is taken. Ranges follow the data (Spark
samples their bounds), so values that crowd together do not end up in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.llm.runs import collapse_runs
from gaitloom.session import durable
from gaitloom.tables import recording_index

#: Values nearer to zero than this share the bin of zero.
TINY = 1e-9


def bin_of(value: Column, error: float) -> Column:
    """Bin number: rising with the value; the middle of a bin is within ``error`` (relative) of all its values."""
    step = (1 + error) / (1 - error)
    magnitude = F.ceil(F.ln(F.greatest(F.abs(value), F.lit(TINY)) / TINY) / F.ln(F.lit(step)))
    return F.when(value > TINY, magnitude + 1).when(value < -TINY, -magnitude - 1).otherwise(F.lit(0)).cast("bigint")


def value_of(b: Column, error: float) -> Column:
    step = (1 + error) / (1 - error)
    middle = F.lit(TINY) * F.pow(F.lit(step), F.abs(b) - 1) * 2 / (1 + step)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * middle)


def summarize(df: DataFrame, by: list[str], value: str, error: float = 0.0) -> DataFrame:
    """Mergeable summary: by..., bin, n. With ``error`` 0 the bin is the value itself.

    Null and NaN values are not counted; null groups are a group of their own; an empty table gives
    an empty summary.
    """
    v = F.col(value).cast("double")
    b = v if error == 0 else bin_of(v, error)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: list[DataFrame], by: list[str]) -> DataFrame:
    """One summary of several with the same error; the order of the parts does not matter."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, by: list[str], probs: list[float], error: float = 0.0) -> DataFrame:
    """by..., n and one column per probability (p50 for 0.5): the first value whose rank reaches prob * n.

    The result is a value of the data (error 0) or within ``error`` of one (relative). The sorted
    counts are written once, as the ranges must not differ between the two uses of them.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in by]
    rows = durable(summary.repartitionByRange(*by, "bin").withColumn("_seg", F.spark_partition_id()))
    totals = rows.groupBy(*by, "_seg").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_seg").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy(*key)).alias("_total"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_seg") == F.col("_s"))
    inner = Window.partitionBy(*key, "_seg").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.join(totals, same).withColumn("_cum", F.col("_below") + F.sum("n").over(inner))
    got = value_of(F.col("bin"), error) if error else F.col("bin")
    picks = [F.min(F.when(F.col("_cum") >= F.greatest(F.ceil(F.col("_total") * F.lit(p) - 1e-9), F.lit(1)), got)).alias(f"p{round(p * 100):02d}") for p in probs]
    return cum.groupBy(*by).agg(F.max("_total").alias("n"), *picks)


def with_group(df: DataFrame, index: DataFrame) -> DataFrame:
    """``df`` (one row per recording and value, already counted) with the recording's group, '(none)' if it has none."""
    idx = recording_index(index).select(F.col("recording").alias("_r"), "group_name")
    return df.join(idx, F.lower(F.trim("recording")) == F.col("_r"), "left").withColumn("group_name", F.coalesce("group_name", F.lit("(none)"))).drop("_r")


def duration_summary(results: DataFrame, info: DataFrame, index: DataFrame, per_day: bool = False) -> DataFrame:
    """Summary of run durations by group_name and behaviour [and day]: exact, as durations are whole frames.

    Runs are counted per recording before the group is joined, so a long recording costs a few rows.
    With ``per_day`` the day is that of the recording's latest load.
    """
    counted = collapse_runs(results, info).groupBy("recording", "behaviour", F.col("duration").cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = ["group_name", "behaviour"]
    if per_day:
        day = results.where("recording is not null").groupBy("recording").agg(F.to_date(F.max("loaded_at")).alias("day"))
        counted, by = counted.join(day, "recording", "left"), ["day", *by]
    return with_group(counted, index).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
