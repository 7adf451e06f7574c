"""Transition graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def undirected(matrix: DataFrame, scale: float = 100.0) -> DataFrame:
    """Edges a < b or a = b with the larger of both directions' weight; zero is no edge."""
    e = matrix.where("p > 0").groupBy("group", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return e.agg((F.max("p") * scale).alias("weight"))


def node_sizes(usage: DataFrame, scale: float = 2000.0, base: float = 1000.0) -> DataFrame:
    """Size of each syllable's node by its share of the group's usage. ``usage``: group, syllable, frequency."""
    return usage.withColumn("size", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("group")) * scale + base)  # one row per label


def circle(labels: DataFrame) -> DataFrame:
    """Positions of the syllables on a circle, in label order."""
    w = Window.partitionBy().orderBy("syllable")  # one row per label
    t = 2 * F.pi() * (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    return labels.select("syllable", F.cos(t).alias("x"), F.sin(t).alias("y"))


def difference(matrix: DataFrame, left: str, right: str, scale: float = 1000.0) -> DataFrame:
    """Edges of left minus right: src, dst, weight (absolute), up (whether left has more)."""
    a = matrix.where(F.col("group") == left).select("src", "dst", F.col("p").alias("pa"))
    b = matrix.where(F.col("group") == right).select("src", "dst", F.col("p").alias("pb"))
    d = (F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))) * scale
    return a.join(b, ["src", "dst"], "full").withColumn("d", d).where("d <> 0").select("src", "dst", F.abs("d").alias("weight"), (F.col("d") > 0).alias("up"))


def node_differences(usage: DataFrame, left: str, right: str, scale: float = 1000.0, base: float = 500.0) -> DataFrame:
    """Nodes of left minus right: syllable, size, up. The size is the syllable's share of all absolute differences of usage; a
    syllable that a group lacks counts as 0 there, without any difference all have the base size. ``usage``: group, syllable, frequency (shares)."""
    of = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("frequency"))), F.lit(0.0))
    d = usage.groupBy("syllable").agg((of(left) - of(right)).alias("d"))
    share = F.coalesce(F.try_divide(F.abs("d"), F.sum(F.abs("d")).over(Window.partitionBy())), F.lit(0.0))  # one row per label
    return d.select("syllable", (share * scale + base).alias("size"), (F.col("d") > 0).alias("up"))
