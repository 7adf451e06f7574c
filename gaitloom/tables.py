"""Reading the canonical tables: rows in force, time blocks, recording metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames per time block. A frame number is a 32-bit integer, so a recording has at most
#: 2**32 / BLOCK (about a million) blocks: windows over one row per block are bounded by that,
#: windows over rows are kept within one block.
BLOCK = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def block_of(frame: Column | str = "frame", size: int = BLOCK) -> Column:
    frame = F.col(frame) if isinstance(frame, str) else frame
    return F.floor(frame / F.lit(size)).cast("int")


def by_block(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``block`` and hash rows by (recording, block).

    Every later grouping or window on (recording, block, ...) reuses this one exchange, and no
    recording, however long, ends up in one task. Rows without recording or frame have no place in
    time and are left out.
    """
    df = df.where("recording is not null and frame is not null").withColumn("block", block_of(size=size))
    return df.repartition("recording", "block")


def in_force(df: DataFrame, values: list[str]) -> DataFrame:
    """One row per (recording, frame): the values with the latest ``loaded_at``.

    ``df`` comes from :func:`by_block`. A null ``loaded_at`` counts as earlier than any other. Rows
    come out sorted by frame inside their block, so that windows along time need no further sort.
    """
    loaded = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62)))
    w = Window.partitionBy("recording", "block").orderBy("frame", "_loaded")
    rows = df.select("recording", "block", "frame", loaded.alias("_loaded"), *values).withColumn("_next", F.lead("frame").over(w))
    return rows.where("_next is null or _next <> frame").select("recording", "block", "frame", *values)


def clean_name(name: Column | str) -> Column:
    """A recording's name as the fact tables write it: no blanks around, no file extension, lower case."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(F.trim(name), r"\.[A-Za-z0-9]{1,5}$", ""))


def clean_group(group: Column | str) -> Column:
    """Group names agree once case, blanks and separators are ignored; an empty one is missing."""
    group = F.col(group) if isinstance(group, str) else group
    g = F.regexp_replace(F.lower(F.trim(group)), r"[\s\-_]+", "_")
    return F.when(g != "", g)


def recording_index(index: DataFrame) -> DataFrame:
    """(recording, group_name, rig, recorded_at), one row per recording however often it is listed.

    Of repeated rows the least non-null value of each column is taken, so the result is defined.
    """
    return (
        index.where("name is not null")
        .groupBy(clean_name("name").alias("recording"))
        .agg(
            F.min(clean_group("group_name")).alias("group_name"),
            F.min("rig").alias("rig"),
            F.min("recorded_at").alias("recorded_at"),
        )
    )


def recording_meta(recordings: DataFrame, index: DataFrame, rigs: DataFrame) -> DataFrame:
    """One row per recording of ``recordings`` with group, rig, rig area, frames a second and recording day.

    A recording that is not listed, or listed without rig, gets the rig whose name its own name
    contains (names carry the rig), else none. ``rigs`` is the fixed table of rigs.
    """
    recs = recordings.select("recording").where("recording is not null").distinct()
    recs = recs.withColumn("_key", clean_name("recording"))
    idx = recording_index(index).withColumnRenamed("recording", "_key").withColumnRenamed("rig", "_rig")
    meta = recs.join(idx, "_key", "left")
    names = [r[0] for r in rigs.select("rig").where("rig is not null").distinct().sort("rig").collect()]
    guess = F.coalesce(*[F.when(F.col("_key").contains(n.lower()), F.lit(n)) for n in names]) if names else F.lit(None)
    meta = meta.withColumn("rig", F.coalesce("_rig", guess).cast("string"))
    area = rigs.where("rig is not null").groupBy("rig").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("fps").alias("fps"))
    return meta.join(area, "rig", "left").select(
        "recording", "group_name", "rig", "width", "height", "fps", F.to_date("recorded_at").alias("day")
    )
