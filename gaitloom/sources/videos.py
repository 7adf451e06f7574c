"""Videos and recordings: matching by name, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitloom.sources.loaders import list_files, recording_name

EXTENSIONS = [".mp4", ".avi", ".mov"]


def videos(spark: SparkSession, paths, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path) of every video file."""
    return list_files(spark, paths, [e if e.startswith(".") else f".{e}" for e in extensions or EXTENSIONS], recursive)


def _named(videos: DataFrame) -> DataFrame:
    return videos.select("path", recording_name("path").alias("video")).groupBy("video").agg(F.max("path").alias("path"))


def match_videos(recordings: DataFrame, videos: DataFrame, suffix: str = "", strict: bool = True) -> DataFrame:
    """recording, path: the video with the longest name that, with ``suffix``, begins the recording's name.

    ``recordings``: recording (folders before the name are ignored); ``videos``: path. Every
    beginning of a name meets the videos in an equi join. A recording without a video is an error
    when rows are read, or with ``strict`` false gets null. Videos of one name count once, the last path.
    """
    name = F.element_at(F.split("recording", "/"), -1)
    keys = recordings.select("recording").where("recording is not null").distinct()
    each = keys.select("recording", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, F.lit(1), i))).alias("start"))
    hits = each.join(_named(videos).select(F.concat("video", F.lit(suffix)).alias("start"), "path"), "start")
    best = hits.groupBy("recording").agg(F.max_by("path", F.length("start")).alias("path"))
    return keys.join(best, "recording", "left").select("recording", _required("path", F.concat(F.lit("no video for "), F.col("recording"))) if strict else F.col("path"))


def _required(column: str, message: Column) -> Column:
    return F.coalesce(F.col(column), F.raise_error(message).cast("string")).alias(column)


def without_video(recordings: DataFrame, matched: DataFrame) -> DataFrame:
    """Recordings that have no row with a path in ``matched``."""
    return recordings.select("recording").distinct().join(matched.where("path is not null").select("recording"), "recording", "left_anti")
