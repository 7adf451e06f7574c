"""Nonparametric group comparisons: ranks, Kruskal-Wallis, Dunn, permutations, false discovery rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.session import durable, spread


def average_ranks(values: DataFrame) -> DataFrame:
    """Adds ``rk``: rank of ``value`` within its syllable, ties sharing their mean rank. ``values``: group, name, syllable, value."""
    w = Window.partitionBy("syllable").orderBy("value")
    ties = Window.partitionBy("syllable", "value")
    return values.withColumn("rk", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def tie_terms(values: DataFrame) -> DataFrame:
    """Per syllable the tie term sum(t^3 - t) / (12 (N - 1)) and N."""
    t = values.groupBy("syllable", "value").agg(F.count(F.lit(1)).alias("t"))
    g = t.groupBy("syllable").agg(F.sum(F.pow("t", 3) - F.col("t")).alias("s"), F.sum("t").alias("N"))
    return g.select("syllable", "N", F.try_divide(F.col("s"), F.lit(12.0) * (F.col("N") - 1)).alias("ties"))


def kruskal(ranks: DataFrame) -> DataFrame:
    """Per syllable the tie-corrected H statistic."""
    per = ranks.groupBy("syllable", "group").agg(F.sum("rk").alias("r"), F.count(F.lit(1)).alias("m"))
    h = per.groupBy("syllable").agg(F.sum(F.pow("r", 2) / F.col("m")).alias("q"))
    h = h.join(tie_terms(ranks), "syllable")
    raw = F.lit(12.0) / (F.col("N") * (F.col("N") + 1)) * F.col("q") - 3 * (F.col("N") + 1)
    correction = 1 - F.col("ties") * 12 * (F.col("N") - 1) / (F.pow(F.col("N"), 3) - F.col("N"))
    return h.select("syllable", F.try_divide(raw, correction).alias("h"))


def dunn(ranks: DataFrame) -> DataFrame:
    """Per syllable and pair of groups (a < b) the absolute Dunn z, ranks being over all groups."""
    per = ranks.groupBy("syllable", "group").agg(F.avg("rk").alias("mean"), F.count(F.lit(1)).alias("m"))
    a = per.select("syllable", F.col("group").alias("a"), F.col("mean").alias("ma"), F.col("m").alias("na"))
    b = per.select("syllable", F.col("group").alias("b"), F.col("mean").alias("mb"), F.col("m").alias("nb"))
    pairs = a.join(b, "syllable").where("a < b").join(tie_terms(ranks), "syllable")  # groups: the study's, not the data's
    var = (F.col("N") * (F.col("N") + 1) / F.lit(12.0) - F.col("ties")) * (F.lit(1.0) / F.col("na") + F.lit(1.0) / F.col("nb"))
    return pairs.select("syllable", "a", "b", F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt(var)).alias("z"))


def fdr(p: DataFrame, by: list[str], column: str = "p", tie: list[str] | None = None) -> DataFrame:
    """Adds ``p_adj``: Benjamini-Hochberg over the rows of each ``by`` group, p above 1 counting as 1."""
    key = [column, *(tie or [])]
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*key))
    raw = p.withColumn("_q", F.least(F.col(column), F.lit(1.0)) * m / rank).withColumn("_r", rank)
    back = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adj", F.least(F.min("_q").over(back), F.lit(1.0))).drop("_q", "_r")


def permutation_test(ranks: DataFrame, n_perm: int = 10_000, seed: int = 42, chunk: int = 1000, block: int = 20_000) -> DataFrame:
    """Per syllable the Kruskal-Wallis H, its permutation p, and per pair Dunn's z and p (rows with a, b).

    Recordings are permuted over the groups, over all of them for H and over those of a pair for z;
    all syllables share a permutation, so one matrix product serves them all. A task holds
    ``block`` recordings and ``chunk`` permutations, which it draws from the seed, and returns sums
    per group; the sums of the blocks are added, compared and counted. What reaches the driver is
    one row per group and label. p is (hits + 1) / n_perm, equal statistics being no hit.
    """
    spark = ranks.sparkSession
    schema = "syllable int, a string, b string, statistic double, p double"
    ranks = durable(ranks)  # one row per recording and label, used four times
    real = ranks.groupBy("group", "syllable").agg(F.sum("rk").alias("r"), F.count(F.lit(1)).alias("m")).toPandas()  # groups x labels
    if real.empty:
        return spark.createDataFrame([], schema)
    names, labels = sorted(real["group"].unique()), sorted(int(v) for v in real["syllable"].unique())
    sums = real.pivot(index="group", columns="syllable", values="r").loc[names, labels].fillna(0.0).to_numpy(float)
    size = real.groupby("group")["m"].max().loc[names].to_numpy(float)
    n, start = int(size.sum()), np.r_[0, np.cumsum(size)[:-1]].astype(int)
    ties = {r.syllable: r.ties or 0.0 for r in tie_terms(ranks).collect()}
    tie = np.array([ties[k] for k in labels]) * 12 * max(n - 1, 0)
    tests = [(-1, -1), *[(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]]

    def members(t: int) -> np.ndarray:
        return np.arange(len(names)) if t == 0 else np.array(tests[t])

    def statistic(t: int, per: np.ndarray) -> np.ndarray:
        """H or z from sums per group: (..., groups of the test, labels)."""
        m = size[members(t)][:, None]
        if t == 0:
            c = 1 - tie / max(n**3 - n, 1)
            return np.where(c > 0, (12.0 / (n * (n + 1)) * (per**2 / m).sum(-2) - 3 * (n + 1)) / np.where(c > 0, c, 1), 0)
        scale = np.sqrt((n * (n + 1) / 12.0 - tie / (12.0 * max(n - 1, 1))) * (1 / m).sum())
        return np.abs(per[..., 0, :] / m[0] - per[..., 1, :] / m[1]) / np.where(scale > 0, scale, np.inf)

    def draw(key, g: pd.DataFrame) -> pd.DataFrame:
        t, c, _ = (int(k) for k in key)
        v, k = np.array(g["v"].tolist(), float).reshape(len(g), len(labels)), g["k"].to_numpy()
        own = members(t)
        owner, rnd = np.repeat(np.arange(len(own)), size[own].astype(int)), np.random.RandomState([seed, c])
        perms, out = min(chunk, n_perm - c * chunk), []
        for i in range(0, perms, 32):
            who = np.stack([owner[rnd.permutation(len(owner))[k]] for _ in range(min(32, perms - i))])
            hot = (who[:, None, :] == np.arange(len(own))[:, None]).reshape(-1, len(k)).astype(float)
            out.append(hot @ v)
        return pd.DataFrame({"test": [t], "chunk": [c], "sums": [np.concatenate(out).tobytes()]})

    def count(key, g: pd.DataFrame) -> pd.DataFrame:
        t = int(key[0])
        per = sum(np.frombuffer(bytes(x), float) for x in g["sums"]).reshape(-1, len(members(t)), len(labels))
        hits = (statistic(t, per) > statistic(t, sums[members(t)]) * (1 + 1e-9) + 1e-12).sum(0)
        return pd.DataFrame({"test": t, "label": np.arange(len(labels)), "hits": hits})

    order = Window.orderBy("group", "name")  # two names a recording, nothing else
    number = ranks.select("group", "name").distinct().withColumn("i", F.row_number().over(order) - 1)
    wide = ranks.groupBy("group", "name").agg(F.map_from_entries(F.collect_list(F.struct("syllable", "rk"))).alias("m"))  # one entry a label
    wide = wide.select("group", "name", F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) for k in labels]).alias("v")).join(number, ["group", "name"])
    g = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("group")) - 1
    base = F.get(F.array(*[F.lit(int(x)) for x in start]), g.cast("int"))
    each = []
    for t, (i, j) in enumerate(tests):
        k = F.col("i") if t == 0 else F.col("i") - base + F.when(g == j, F.lit(int(size[i]))).otherwise(0)
        inside = F.lit(True) if t == 0 else (g == i) | (g == j)
        each.append(F.when(inside, F.struct(F.lit(t).alias("test"), k.cast("bigint").alias("k"))))
    parts = wide.select("v", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e")).select("v", "e.test", "e.k", F.floor(F.col("e.k") / block).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // chunk) - 1))).alias("chunk"))
    drawn = spread(parts, "test", "chunk", "block").groupBy("test", "chunk", "block").applyInPandas(draw, "test int, chunk int, sums binary")
    hits = spread(drawn, "test", "chunk").groupBy("test", "chunk").applyInPandas(count, "test int, label int, hits bigint").groupBy("test", "label").agg(F.sum("hits").alias("hits"))
    known = [(t, s, labels[s], None if t == 0 else names[i], None if t == 0 else names[j], float(v)) for t, (i, j) in enumerate(tests) for s, v in enumerate(statistic(t, sums[members(t)]))]
    known = spark.createDataFrame(known, "test int, label int, syllable int, a string, b string, statistic double")  # labels x pairs of groups
    return known.join(hits, ["test", "label"]).select("syllable", "a", "b", "statistic", ((F.col("hits") + 1) / n_perm).alias("p"))


def significant_pairs(tests: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pairs whose adjusted Dunn p is below the threshold for syllables whose adjusted H p is not above it."""
    kw = fdr(tests.where("a is null").withColumn("_all", F.lit(1)), ["_all"], tie=["syllable"]).where(F.col("p_adj") <= threshold).select("syllable")
    dn = fdr(tests.where("a is not null"), ["syllable"], tie=["a", "b"])
    return dn.where(F.col("p_adj") < threshold).join(kw, "syllable", "left_semi").select("syllable", "a", "b", "statistic", "p", "p_adj")
