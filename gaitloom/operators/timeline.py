"""Ordered work inside recordings of any length: dense positions, chunks with margins, runs.

A window partitioned by recording alone would put a recording that holds a third of all rows into
one task. Rows get their dense position in the recording (per-block counts give each block its
offset), and windows run over chunks of ``CHUNK`` positions that borrow a margin from their
neighbours, which is exact for every operator of bounded reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaitloom.tables import by_block, in_force

CHUNK = 4096


def positions(rows: DataFrame, key: str = "recording", block: str = "block", order: str = "frame") -> DataFrame:
    """Add ``pos`` (0, 1, ... in the key's order) and ``n`` (rows of the key). ``rows`` are in blocks ordered like ``order``."""
    local = F.row_number().over(Window.partitionBy(key, block).orderBy(order)) - 1
    per = rows.groupBy(key, block).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    per = per.select(F.col(key).alias("_k"), F.col(block).alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(key)).alias("n"))
    out = rows.withColumn("_l", local).join(per, (F.col(key) == F.col("_k")) & (F.col(block) == F.col("_b")))
    return out.withColumn("pos", F.col("_o") + F.col("_l")).drop("_l", "_o", "_k", "_b")


def chunked(rows: DataFrame, before: int, after: int, key: str = "recording", pos: str = "pos", size: int = CHUNK) -> DataFrame:
    """Each row in its chunk and, as a guest (``own`` false), in the chunks whose margins it lies in."""
    chunk = lambda d: F.floor((F.col(pos) + d) / F.lit(size)).cast("bigint")
    out = rows.withColumn("_home", chunk(0)).withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(0), chunk(before), chunk(-after)))))
    return out.withColumn("own", F.col("chunk") == F.col("_home")).drop("_home").repartition(key, "chunk")


def course(key: str = "recording", pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(key, "chunk").orderBy(pos)


def mirrored(rows: DataFrame, radius: int, pos: str = "pos", n: str = "n") -> DataFrame:
    """Add the reflected rows a filter of ``radius`` meets beyond the ends (d c b a | a b c d | d c b a)."""
    p, m = F.col(pos), F.col(n)
    folds = F.sequence(-F.floor(F.lit(radius) / (2 * m)) - 1, F.floor(F.lit(radius) / (2 * m)) + 1)
    images = F.flatten(F.transform(folds, lambda k: F.array(p + 2 * m * k, 2 * m * k - 1 - p)))
    near = F.when((p < radius) | (p >= m - radius), F.filter(images, lambda q: (q >= -radius) & (q < m + radius))).otherwise(F.array(p))
    return rows.withColumn("real", p).withColumn(pos, F.explode(near))


def states(results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in force that have a syllable, with ``pos`` and ``n``."""
    cols = ["syllable", *(columns or [])]
    rows = in_force(by_block(results.select("recording", "frame", "loaded_at", *cols)), cols).where("syllable is not null")
    return positions(rows)


def run_numbers(rows: DataFrame, label: str = "syllable") -> DataFrame:
    """recording, pos, n, ``label`` and the number of the run each row lies in (0, 1, ...)."""
    w = course()
    marked = chunked(rows.select("recording", "pos", "n", label), 1, 0)
    new = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1))
    marked = marked.withColumn("_new", new).where("own")
    local = F.sum("_new").over(w)
    per = marked.groupBy("recording", "chunk").agg(F.sum("_new").alias("_c"))
    before = Window.partitionBy("recording").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    per = per.select(F.col("recording").alias("_k"), F.col("chunk").alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    numbered = marked.withColumn("_l", local).join(per, (F.col("recording") == F.col("_k")) & (F.col("chunk") == F.col("_b")))
    return numbered.select("recording", "pos", "n", label, (F.col("_o") + F.col("_l") - 1).alias("run"))


def runs(rows: DataFrame, label: str = "syllable") -> DataFrame:
    """Run-length encoding: recording, run (0, 1, ...), ``label``, start, end (positions, half open), n (rows of the recording)."""
    return run_numbers(rows, label).groupBy("recording", "run").agg(F.min(label).alias(label), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.max("n").alias("n"))


def successors(run_rows: DataFrame, n: int, label: str = "syllable") -> DataFrame:
    """Runs with the labels of the ``n`` runs after them (``next1``...), null past the end."""
    w = course(pos="run")
    c = chunked(run_rows, 0, n, pos="run")
    return c.select("*", *[F.lead(label, i).over(w).alias(f"next{i}") for i in range(1, n + 1)]).where("own").drop("own", "chunk")


def onset(col: Column, w: WindowSpec) -> Column:
    return F.coalesce(col != F.lag(col).over(w), F.lit(True))
