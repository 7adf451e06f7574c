"""Writing results, keypoints and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_results(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results partitioned by recording; recordings already there are refused unless ``overwrite``, which replaces just them."""
    spark = results.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    have = spark.read.parquet(path).select("recording").distinct() if there else None  # a folder that cannot be read is an error, not an empty one
    if have is not None and not overwrite:
        clash = results.select("recording").distinct().join(have, "recording", "left_semi").limit(5).collect()
        if clash:
            raise ValueError("already saved: " + ", ".join(r.recording for r in clash))
    w = results.repartition("recording").write.partitionBy("recording")
    if overwrite:
        w.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        w.mode("append").parquet(path)


def results_csv(results: DataFrame, latent: int = 3, dims: int = 2) -> DataFrame:
    """The columns of a results CSV in order: syllable, centroid x/y[/z], heading, latent_state i; 4 decimals, half to even."""
    r = lambda c: F.bround(c, 4)
    cols = [F.col("syllable")] + [r(F.get("centroid", F.lit(i))).alias(f"centroid {a}") for i, a in zip(range(dims), "xyz")] + [r(F.col("heading")).alias("heading")]
    return results.select("recording", "frame", *cols, *[r(F.get("latent_state", F.lit(i))).alias(f"latent_state {i}") for i in range(latent)])


def save_results_csv(results: DataFrame, path: str, **shape) -> None:
    """One folder per recording, frames in order."""
    results_csv(results, **shape).repartition("recording").sortWithinPartitions("recording", "frame").write.partitionBy("recording").option("header", "true").mode("overwrite").csv(path)


def keypoints_wide(frames: DataFrame, bodyparts: list[str], dims: int = 2, conf: bool = True) -> DataFrame:
    """<part>_x, _y[, _z][, _conf] per frame; NaN is written as null, as everywhere."""
    plain = lambda v: F.when(~F.isnan(v), v)
    at = lambda k, d: plain(F.get(F.get("pose", F.lit(k)), F.lit(d)))
    cols = []
    for k, b in enumerate(bodyparts):
        cols += [at(k, d).alias(f"{b}_{a}") for d, a in zip(range(dims), "xyz")] + ([plain(F.get("conf", F.lit(k))).alias(f"{b}_conf")] if conf else [])
    return frames.select("recording", "frame", *cols)


def save_keypoints_csv(frames: DataFrame, path: str, bodyparts: list[str], **shape) -> None:
    keypoints_wide(frames, bodyparts, **shape).repartition("recording").sortWithinPartitions("recording", "frame").drop("frame").write.partitionBy("recording").option("header", "true").mode("overwrite").csv(path)


def updated_index(index: DataFrame, recordings: DataFrame) -> DataFrame:
    """The index with every missing recording added to group 'default'."""
    new = recordings.select(F.col("recording").alias("name")).distinct().join(index.select("name"), "name", "left_anti")
    return index.select("name", "group").unionByName(new.select("name", F.lit("default").alias("group")))


def syllable_info(syllables: DataFrame, movies: DataFrame) -> DataFrame:
    """syllable, label, short_description, movie_path over all syllables and movies; nothing is the empty string. ``movies``: path."""
    n = F.regexp_extract("path", r"syllable(\d+)", 1).try_cast("int")
    m = movies.select(n.alias("syllable"), F.col("path").alias("movie_path")).where("syllable is not null").groupBy("syllable").agg(F.min("movie_path").alias("movie_path"))
    out = syllables.select("syllable").distinct().join(m, "syllable", "full")
    return out.select("syllable", F.lit("").alias("label"), F.lit("").alias("short_description"), F.coalesce("movie_path", F.lit("")).alias("movie_path"))


def load_tables(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that :func:`save_tables` wrote; one that is not there is refused by the reader."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def save_annotations(annotations: DataFrame, path: str, comments: list[str] | None = None) -> None:
    """Comment lines (#), then key, coordinate_index, video_frame_index, bodypart, x, y: one text file, as annotations are made by hand."""
    columns = ["key", "coordinate_index", "video_frame_index", "bodypart", "x", "y"]
    spark = annotations.sparkSession
    head = [f"# {c}" for c in comments or []] + [",".join(columns)]
    lines = annotations.select(F.lit(len(head)).alias("i"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    top = spark.createDataFrame(list(enumerate(head)), "i int, value string")
    top.unionByName(lines).repartition(1).sortWithinPartitions("i", "value").select("value").write.mode("overwrite").text(path)


def save_tables(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Several tables as one folder each; an existing folder is refused unless ``overwrite``."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "error").parquet(f"{folder}/{name}")
