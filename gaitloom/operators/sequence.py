"""Usage, durations, transitions and relabelling of state sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.operators.timeline import chunked, course, onset, successors


def dense_labels(rows: DataFrame) -> DataFrame:
    """0 to the largest label, one row each; the number of labels is the model's, not the data's."""
    return rows.agg(F.max("syllable").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("syllable"))


def frequency(rows: DataFrame) -> DataFrame:
    """Share of rows (runs or frames) per label 0..max, zero where a label is absent."""
    n = rows.groupBy("syllable").agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy())  # one row per label
    return dense_labels(rows).join(n, "syllable", "left").select("syllable", share.alias("frequency"))


def frequency_per_recording(run_rows: DataFrame) -> DataFrame:
    """Share of a recording's runs per label that occurs in it."""
    n = run_rows.groupBy("recording", "syllable").agg(F.count(F.lit(1)).alias("n"))
    return n.select("recording", "syllable", (F.col("n") / F.sum("n").over(Window.partitionBy("recording"))).alias("frequency"))


def onsets(rows: DataFrame) -> DataFrame:
    """recording, frame, syllable, onset: whether the label differs from the row before in the same recording."""
    return chunked(rows, 1, 0).withColumn("onset", onset(F.col("syllable"), course())).where("own").select("recording", "frame", "syllable", "onset")


def onsets_across(rows: DataFrame) -> DataFrame:
    """The same over all recordings laid end to end by name: a first row may continue the previous recording."""
    firsts = rows.where("pos = 0").select("recording", F.col("syllable").alias("first"))
    lasts = rows.where("pos = n - 1").select("recording", F.col("syllable").alias("last"))
    # which recording comes before: names in ranges of their first letters, then the last of the range before
    names = firsts.join(lasts, "recording").withColumn("part", F.substring("recording", 1, 4))
    w = Window.partitionBy("part").orderBy("recording")
    ends = names.groupBy("part").agg(F.max_by("last", "recording").alias("part_last"))
    ends = ends.select(F.col("part").alias("_p"), F.lag("part_last").over(Window.partitionBy().orderBy("part")).alias("_before"))  # one row per prefix
    flags = names.withColumn("_prev", F.lag("last").over(w)).join(ends, F.col("part") == F.col("_p")).select(
        F.col("recording").alias("_r"), F.coalesce(F.col("first") != F.coalesce("_prev", "_before"), F.lit(True)).alias("_on")
    )
    per = onsets(rows.select("recording", "frame", "syllable", "pos", "n"))
    lead = rows.where("pos = 0").select("recording", "frame", F.lit(True).alias("_is0"))
    out = per.join(lead, ["recording", "frame"], "left").join(flags, F.col("recording") == F.col("_r"))
    return out.select("recording", "frame", "syllable", F.when(F.col("_is0"), F.col("_on")).otherwise(F.col("onset")).alias("onset"))


def ngrams(run_rows: DataFrame, n: int = 2, max_label: int = 99) -> DataFrame:
    """Tuples of successive run labels (l1..ln) with their counts per recording.

    The first run of a recording is left out, as are tuples with a label of ``max_label`` or more.
    """
    t = successors(run_rows.where("run > 0"), n - 1).withColumnRenamed("syllable", "l1")
    t = t.withColumnsRenamed({f"next{i}": f"l{i + 1}" for i in range(1, n)}).where(f"l{n} is not null")
    names = [f"l{i}" for i in range(1, n + 1)]
    return t.where(" and ".join(f"{c} < {max_label}" for c in names)).groupBy("recording", *names).agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(bigrams: DataFrame, by: list[str], normalize: str = "bigram", smoothing: float = 0.0) -> DataFrame:
    """Sparse transition probabilities by..., src, dst, n, p. normalize: bigram, rows, columns, or anything else for counts."""
    m = bigrams.groupBy(*by, F.col("l1").alias("src"), F.col("l2").alias("dst")).agg((F.sum("n") + smoothing).alias("n"))
    over = {"bigram": by, "rows": [*by, "src"], "columns": [*by, "dst"]}
    if normalize not in over:
        return m.withColumn("p", F.col("n").cast("double"))
    return m.withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*over[normalize]))))


def dense_matrix(sparse: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Every (src, dst) of ``labels`` (a model's fixed set) per group, zero where absent."""
    grid = labels.select(F.col("syllable").alias("src")).crossJoin(labels.select(F.col("syllable").alias("dst")))
    if by:
        grid = sparse.select(*by).distinct().crossJoin(grid)
    return grid.join(sparse, [*by, "src", "dst"], "left").na.fill({"n": 0, "p": 0.0})


def merge_mapping(usage: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(old, new): listed syllables merge, the rest stay alone; new labels by falling usage.

    Equal usage: the group with the larger least label first.
    """
    pairs = [(i, s) for i, g in enumerate(groups) for s in g]
    listed = usage.sparkSession.createDataFrame(pairs, "grp int, syllable int")
    g = usage.join(listed, "syllable", "left").withColumn("grp", F.coalesce(F.col("grp").cast("bigint"), F.col("syllable") + len(groups)))
    tot = g.groupBy("grp").agg(F.sum("frequency").alias("f"), F.min("syllable").alias("least"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("f", 12)), F.desc("least"))) - 1  # one row per label
    return g.join(tot.select("grp", rank.alias("new")), "grp").select(F.col("syllable").alias("old"), "new")


def relabel(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with ``syllable`` replaced by the mapping; labels it does not know are refused by an error at run time."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = rows.join(m, F.col("syllable") == F.col("_old"), "left")
    new = F.when(F.col("syllable").isNotNull() & F.col("_new").isNull(), F.raise_error(F.lit("a syllable is missing from the mapping")).cast("int")).otherwise(F.col("_new"))
    return out.withColumn("syllable", new.cast("int")).drop("_old", "_new")


def frequency_order(usage: DataFrame) -> DataFrame:
    """(old, new): labels by falling usage, equal ones by falling label."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("frequency", 12)), F.desc("syllable"))) - 1  # one row per label
    return usage.select(F.col("syllable").alias("old"), rank.alias("new"))


def confusion(a: DataFrame, b: DataFrame, normalize: bool = True, min_frequency: float = 0.0) -> DataFrame:
    """Frames with label ``first`` in ``a`` and ``second`` in ``b``: first, second, n[, p]; rare labels dropped after normalising."""
    pairs = a.select("recording", "frame", F.col("syllable").alias("first")).join(b.select("recording", "frame", F.col("syllable").alias("second")), ["recording", "frame"])
    m = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    m = m.withColumn("_f", F.sum("n").over(Window.partitionBy("first"))).withColumn("_s", F.sum("n").over(Window.partitionBy("second"))).withColumn("_t", F.sum("n").over(Window.partitionBy()))  # label pairs
    m = m.withColumn("p", F.col("n") / F.col("_f") if normalize else F.col("n").cast("double"))
    return m.where((F.col("_f") / F.col("_t") > min_frequency) & (F.col("_s") / F.col("_t") > min_frequency)).select("first", "second", "n", "p")


def histogram(durations: DataFrame, width: int) -> DataFrame:
    """Density of ``duration`` in bins of ``width``: bin, n, density."""
    h = durations.groupBy(F.floor(F.col("duration") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy()) * F.lit(width)))  # one row per bin
