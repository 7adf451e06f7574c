"""Reading tracking data and tables of a project into the canonical long form.

Every loader returns recording, frame, bodypart, x, y[, z], conf. Text formats are split into rows
by Spark and unpivoted by expressions over arrays; binary formats are read file by file in Python
workers and need an optional package.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "recording string, frame int, bodypart string, x double, y double, z double, conf double"


def list_files(spark: SparkSession, paths: str | list[str], extensions: list[str], recursive: bool = True) -> DataFrame:
    """(path) of every file below ``paths`` with one of the extensions, case ignored, each once, sorted."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = r.load(paths).select("path")
    low = F.lower("path")
    ok = F.lit(False)
    for e in extensions:
        ok = ok | low.endswith(e.lower())
    return df.where(ok).distinct().orderBy("path")


def recording_name(path: Column | str, path_in_name: bool = False, sep: str = "-", remove_extension: bool = True) -> Column:
    """A recording's name from its file's path."""
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"^[a-z]+:/*", "/")
    if remove_extension:
        p = F.regexp_replace(p, r"\.[^./]*$", "")
    return F.replace(F.regexp_replace(p, "^/+", ""), F.lit("/"), F.lit(sep)) if path_in_name else F.element_at(F.split(p, "/"), -1)


def _numbered(spark: SparkSession, paths, pattern: str) -> DataFrame:
    """(path, line, row): lines of text files with their number; one file's lines stay together."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line")).where("line <> ''")


def deeplabcut_csv(spark: SparkSession, paths, pattern: str = "*.csv", exclude: tuple[str, ...] = ("single",), **name) -> DataFrame:
    """Single- and multi-animal tables: three or four header rows, then index, x, y, likelihood per body part.

    With several animals each becomes a recording "<name>_<animal>".
    """
    rows = _numbered(spark, paths, pattern).withColumn("f", F.split("line", ","))
    head = rows.where("row < 4").groupBy("path").agg(*[F.max(F.when(F.col("row") == i, F.col("f"))).alias(f"h{i}") for i in range(4)])
    multi = F.lower(F.get("h1", F.lit(0))) == "individuals"
    head = head.select("path", multi.alias("multi"), F.when(multi, F.col("h1")).alias("animal"), F.when(multi, F.col("h2")).otherwise(F.col("h1")).alias("part"))
    data = rows.join(head.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p")).where(F.col("row") >= F.when(F.col("multi"), 4).otherwise(3))
    num = lambda i: F.expr("null").cast("double") if i is None else F.get("f", i).try_cast("double")
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / 3).cast("int") - 1), lambda k: k * 3 + 1)
    cells = data.select("path", F.get("f", F.lit(0)).try_cast("double").cast("int").alias("frame"), "animal", "part", "f", F.explode(starts).alias("c"))
    rec = recording_name("path", **name)
    animal = F.get("animal", F.col("c"))
    out = cells.where(animal.isNull() | ~animal.isin(*exclude)) if exclude else cells
    return out.select(
        F.when(animal.isNotNull(), F.concat_ws("_", rec, animal)).otherwise(rec).alias("recording"), "frame", F.get("part", F.col("c")).alias("bodypart"),
        num(F.col("c")).alias("x"), num(F.col("c") + 1).alias("y"), F.lit(None).cast("double").alias("z"), num(F.col("c") + 2).alias("conf"),
    )


def _wide_csv(spark: SparkSession, paths, pattern: str, score: str, frame: str | None, **name) -> DataFrame:
    rows = _numbered(spark, paths, pattern).withColumn("f", F.split("line", ","))
    head = rows.where("row = 0").select(F.col("path").alias("_p"), F.col("f").alias("h"))
    data = rows.where("row > 0").join(head, F.col("path") == F.col("_p"))
    at = lambda n: F.get("f", (F.array_position("h", n) - 1).cast("int")).try_cast("double")
    parts = F.transform(F.filter("h", lambda c: c.endswith("_x")), lambda c: F.substring(c, F.lit(1), F.length(c) - 2))
    rows = data.select("path", "row", "f", "h", F.explode(parts).alias("bodypart"))
    there = lambda s: F.when(F.array_position("h", F.concat("bodypart", F.lit(s))) > 0, at(F.concat("bodypart", F.lit(s))))
    fr = at(F.lit(frame)).cast("int") if frame else (F.col("row") - 1)
    return rows.select(recording_name("path", **name).alias("recording"), fr.cast("int").alias("frame"), "bodypart", there("_x").alias("x"), there("_y").alias("y"), there("_z").alias("z"), F.coalesce(there(score), F.lit(1.0)).alias("conf"))


def anipose_csv(spark: SparkSession, paths, pattern: str = "*.csv", **name) -> DataFrame:
    """Columns <part>_x, _y, _z, _score; conf is the score."""
    return _wide_csv(spark, paths, pattern, "_score", None, **name)


def keypoint_csv(spark: SparkSession, paths, pattern: str = "*.csv", **name) -> DataFrame:
    """The engine's own export: <part>_x, _y[, _z][, _conf]."""
    return _wide_csv(spark, paths, pattern, "_conf", None, **name)


def freipose_json(spark: SparkSession, paths, pattern: str = "*.json", **name) -> DataFrame:
    """Lists of {kp_xyz: [[[x, y, z], ...]]}; conf is 1, body parts are numbered."""
    schema = "kp_xyz array<array<array<double>>>"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths, wholetext=True)
    docs = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{schema.replace(' ', ':', 1)}>>").alias("d"))
    frames = docs.select("path", F.posexplode(F.flatten(F.transform("d", lambda e: e["kp_xyz"]))).alias("frame", "pts"))
    pts = frames.select("path", "frame", F.posexplode("pts").alias("k", "p"))
    return pts.select(recording_name("path", **name).alias("recording"), "frame", F.concat(F.lit("bodypart"), F.col("k")).alias("bodypart"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), F.get("p", F.lit(2)).alias("z"), F.lit(1.0).alias("conf"))


def _binary(spark: SparkSession, paths, pattern: str, parse: Callable[[bytes, str], list[pd.DataFrame]], **name) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select(recording_name("path", **name).alias("recording"), "content")

    def read(batches):
        for b in batches:
            for rec, content in zip(b["recording"], b["content"]):
                yield from parse(bytes(content), rec)

    return files.mapInPandas(read, LONG)


def _long(rec: str, xyz, conf, parts) -> pd.DataFrame:
    import numpy as np

    t, k, d = xyz.shape
    z = xyz[:, :, 2].ravel() if d > 2 else np.full(t * k, np.nan)
    return pd.DataFrame({"recording": rec, "frame": np.repeat(np.arange(t), k), "bodypart": np.tile(np.array(parts, object), t), "x": xyz[:, :, 0].ravel(), "y": xyz[:, :, 1].ravel(), "z": z, "conf": conf.ravel()})


def sleap_hdf5(spark: SparkSession, paths, pattern: str = "*.{slp,h5}", **name) -> DataFrame:
    """tracks (track, dims, part, frame), point_scores, node_names. Needs h5py on the workers."""

    def parse(content: bytes, rec: str):
        import io

        import h5py

        with h5py.File(io.BytesIO(content)) as f:
            tracks, scores, nodes = f["tracks"][()], f["point_scores"][()], [n.decode() for n in f["node_names"][()]]
        for i in range(len(tracks)):
            yield _long(rec if len(tracks) == 1 else f"{rec}_track{i}", tracks[i].transpose(2, 1, 0), scores[i].T, nodes)

    return _binary(spark, paths, pattern, parse, **name)


def sleap_anipose_hdf5(spark: SparkSession, paths, pattern: str = "*.h5", **name) -> DataFrame:
    """tracks (frame, track, part, 3); conf 1 without point_scores. Needs h5py on the workers."""

    def parse(content: bytes, rec: str):
        import io

        import h5py
        import numpy as np

        with h5py.File(io.BytesIO(content)) as f:
            tracks = f["tracks"][()]
            scores = f["point_scores"][()] if "point_scores" in f else np.ones(tracks.shape[:3])
        parts = [f"bodypart{i}" for i in range(tracks.shape[2])]
        for i in range(tracks.shape[1]):
            yield _long(rec if tracks.shape[1] == 1 else f"{rec}_track{i}", tracks[:, i], scores[:, i], parts)

    return _binary(spark, paths, pattern, parse, **name)


def facemap_hdf5(spark: SparkSession, paths, pattern: str = "*.h5", **name) -> DataFrame:
    """Facemap/<part>/{x, y, likelihood}. Needs h5py on the workers."""

    def parse(content: bytes, rec: str):
        import io

        import h5py
        import numpy as np

        with h5py.File(io.BytesIO(content)) as f:
            g = f["Facemap"]
            parts = sorted(g)
            xy = np.stack([np.stack([g[p]["x"][()], g[p]["y"][()]], -1) for p in parts], 1)
            conf = np.stack([g[p]["likelihood"][()] for p in parts], 1)
        yield _long(rec, xy, conf, parts)

    return _binary(spark, paths, pattern, parse, **name)


def deeplabcut_hdf5(spark: SparkSession, paths, pattern: str = "*.h5", **name) -> DataFrame:
    """A stored table with (scorer, part, coordinate) columns. Needs PyTables on the workers."""

    def parse(content: bytes, rec: str):
        import tempfile

        import numpy as np

        with tempfile.NamedTemporaryFile(suffix=".h5") as f:
            f.write(content)
            f.flush()
            df = pd.read_hdf(f.name)
        levels = df.columns.names
        groups = [(rec, df)] if "individuals" not in levels else [(f"{rec}_{i}", df.xs(i, axis=1, level="individuals")) for i in df.columns.unique("individuals") if i != "single"]
        for r, d in groups:
            a = d.to_numpy().reshape(len(d), -1, 3)
            yield _long(r, a[:, :, :2], a[:, :, 2], list(dict.fromkeys(d.columns.get_level_values("bodyparts"))))
        del np

    return _binary(spark, paths, pattern, parse, **name)


def dannce_mat(spark: SparkSession, paths, pattern: str = "*.mat", **name) -> DataFrame:
    """pred (frame, 3, part); conf is 1. Needs SciPy on the workers."""

    def parse(content: bytes, rec: str):
        import io

        import numpy as np
        from scipy.io import loadmat

        xyz = loadmat(io.BytesIO(content))["pred"].transpose(0, 2, 1)
        yield _long(rec, xyz, np.ones(xyz.shape[:2]), [f"bodypart{i}" for i in range(xyz.shape[1])])

    return _binary(spark, paths, pattern, parse, **name)


def nwb(spark: SparkSession, paths, pattern: str = "*.nwb", **name) -> DataFrame:
    """Exactly one pose estimation object with one series per body part. Needs h5py on the workers."""

    def parse(content: bytes, rec: str):
        import io

        import h5py
        import numpy as np

        found: list = []
        with h5py.File(io.BytesIO(content)) as f:
            f.visititems(lambda n, o: found.append(o) if o.attrs.get("neurodata_type") in ("PoseEstimation", b"PoseEstimation") else None)
            if len(found) != 1:
                raise ValueError(f"{rec}: {len(found)} pose estimation objects")
            series = {k: o for k, o in found[0].items() if isinstance(o, h5py.Group) and "data" in o}
            xy = np.stack([o["data"][()] for o in series.values()], 1)
            conf = np.stack([o["confidence"][()] if "confidence" in o else np.ones(len(o["data"])) for o in series.values()], 1)
        yield _long(rec, xy, conf, list(series))

    return _binary(spark, paths, pattern, parse, **name)


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "deeplabcut": deeplabcut_csv, "deeplabcut-hdf5": deeplabcut_hdf5, "sleap": sleap_hdf5, "anipose": anipose_csv, "sleap-anipose": sleap_anipose_hdf5,
    "nwb": nwb, "facemap": facemap_hdf5, "freipose": freipose_json, "dannce": dannce_mat, "keypoints": keypoint_csv,
}


def register_format(name: str, loader: Callable[..., DataFrame]) -> None:
    """Add a loader: (spark, paths, **options) -> long form."""
    FORMATS[name] = loader


def load_keypoints(spark: SparkSession, paths, format: str, **options) -> DataFrame:
    """Long form of all files of a format. Two files with one recording's name are refused; several recordings may
    come from one file. Body parts that differ between recordings are refused by :func:`to_frames`."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; there are {', '.join(sorted(FORMATS))}")
    takes = inspect.signature(FORMATS[format]).parameters
    if "pattern" in takes:  # a loader of one file per recording
        name = {k: v for k, v in options.items() if k in ("path_in_name", "sep", "remove_extension")}
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", options.get("pattern", takes["pattern"].default)).load(paths)
        same = files.select(recording_name("path", **name).alias("recording"), "path").groupBy("recording").agg(F.collect_set("path").alias("p")).where(F.size("p") > 1)
        if twice := same.orderBy("recording").limit(5).collect():  # at most five names
            raise ValueError("one name, several files: " + "; ".join(f"{r.recording}: {', '.join(sorted(r.p))}" for r in twice))
    return FORMATS[format](spark, paths, **options)


def missing_share(points: DataFrame, by_recording: bool = False) -> DataFrame:
    """[recording,] bodypart, missing, much: share of rows without position, and whether it is over a half. ``points``: long form."""
    by = (["recording"] if by_recording else []) + ["bodypart"]
    gone = (F.col("x").isNull() | F.isnan("x") | F.col("y").isNull() | F.isnan("y")).cast("double")
    return points.groupBy(*by).agg(F.avg(gone).alias("missing")).withColumn("much", F.col("missing") > 0.5)


def uneven_bodyparts(long: DataFrame) -> DataFrame:
    """Recordings whose set of body parts is not that of all: recording, lacks, beyond the fewest (names lacking)."""
    have = long.select("recording", "bodypart").distinct()
    all_ = have.select("bodypart").distinct()
    full = have.select("recording").distinct().crossJoin(F.broadcast(all_))  # body parts: the tracker's fixed list
    return full.join(have, ["recording", "bodypart"], "left_anti").groupBy("recording").agg(F.sort_array(F.collect_list("bodypart")).alias("lacks"))


def overlapping_names(loaded: DataFrame) -> DataFrame:
    """Recordings that several files claim. ``loaded``: recording, path."""
    return loaded.groupBy("recording").agg(F.countDistinct("path").alias("files")).where("files > 1")


def reindex(frames: DataFrame, bodyparts: list[str], use: list[str]) -> DataFrame:
    """``frames`` with the keypoint axis of pose and conf reduced to ``use`` in its order; NaN becomes null.

    A name that is no body part is refused. A null array stays null, an absent cell is null.
    """
    if unknown := [b for b in use if b not in bodyparts]:
        raise ValueError("no body part: " + ", ".join(unknown))
    order = F.array(*[F.lit(bodyparts.index(b)) for b in use])
    plain = lambda v: F.when(~F.isnan(v), v)
    pose = F.when(F.col("pose").isNotNull(), F.transform(order, lambda i: F.transform(F.get("pose", i), plain)))
    conf = F.when(F.col("conf").isNotNull(), F.transform(order, lambda i: plain(F.get("conf", i))))
    return frames.withColumns({"pose": pose, "conf": conf})


def to_frames(long: DataFrame, bodyparts: list[str]) -> DataFrame:
    """Canonical frames: recording, frame, pose and conf in the order of ``bodyparts``.

    Recordings that lack some of each other's body parts are refused, as animals of one file must agree.
    """
    if bad := uneven_bodyparts(long).orderBy("recording").limit(5).collect():  # at most five names
        raise ValueError("body parts differ: " + "; ".join(f"{r.recording} lacks {', '.join(r.lacks)}" for r in bad))
    cells = long.where(F.col("bodypart").isin(bodyparts)).groupBy("recording", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bodypart", F.struct("x", "y", "z", "conf")))).alias("m"))
    get = lambda b: F.try_element_at("m", F.lit(b))
    point = lambda b: F.when(get(b)["z"].isNull(), F.array(get(b)["x"], get(b)["y"])).otherwise(F.array(get(b)["x"], get(b)["y"], get(b)["z"]))
    return cells.select("recording", "frame", F.array(*[point(b) for b in bodyparts]).alias("pose"), F.array(*[get(b)["conf"] for b in bodyparts]).alias("conf"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV dimension such as the index or the syllable information; types are taken from the values."""
    return spark.read.option("header", "true").option("inferSchema", "true").option("comment", "#").csv(path)
