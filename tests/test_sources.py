import json

import pytest
from fixtures import frames, results
from pyspark.sql import functions as F

from gaitloom.sources import config, sinks
from gaitloom.sources.loaders import FORMATS, list_files, load_keypoints, overlapping_names, recording_name, register_format, to_frames


def put(folder, name, text):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text(text)
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.select("recording", "frame", "bodypart", "x", "y", "conf").collect())


def test_deeplabcut_single_and_multi(spark, tmp_path):
    put(tmp_path / "a", "one.csv", "scorer,s,s,s,s,s,s\nbodyparts,nose,nose,nose,tail,tail,tail\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n1,5,6,0.7,,,\n")
    got = rows(load_keypoints(spark, str(tmp_path / "a"), "deeplabcut"))
    assert got == [("one", 0, "nose", 1.0, 2.0, 0.9), ("one", 0, "tail", 3.0, 4.0, 0.8), ("one", 1, "nose", 5.0, 6.0, 0.7), ("one", 1, "tail", None, None, None)]
    put(tmp_path / "b", "two.csv", "scorer,s,s,s,s,s,s\nindividuals,m1,m1,m1,single,single,single\nbodyparts,nose,nose,nose,box,box,box\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n")
    assert rows(load_keypoints(spark, str(tmp_path / "b"), "deeplabcut")) == [("two_m1", 0, "nose", 1.0, 2.0, 0.9)]


def test_anipose_and_own_csv(spark, tmp_path):
    put(tmp_path / "a", "x.csv", "nose_x,nose_y,nose_z,nose_error,nose_score,fnum\n1,2,3,0,0.5,0\n4,5,6,0,0.25,1\n")
    got = load_keypoints(spark, str(tmp_path / "a"), "anipose").orderBy("frame").collect()
    assert [(r.frame, r.x, r.y, r.z, r.conf) for r in got] == [(0, 1, 2, 3, 0.5), (1, 4, 5, 6, 0.25)]
    put(tmp_path / "b", "y.csv", "nose_x,nose_y\n1,2\n")
    assert rows(load_keypoints(spark, str(tmp_path / "b"), "keypoints")) == [("y", 0, "nose", 1.0, 2.0, 1.0)]


def test_freipose(spark, tmp_path):
    put(tmp_path / "a", "f.json", json.dumps([{"kp_xyz": [[[1, 2, 3], [4, 5, 6]]]}, {"kp_xyz": [[[7, 8, 9], [1, 1, 1]]], "kp_score": 1}]))
    got = rows(load_keypoints(spark, str(tmp_path / "a"), "freipose"))
    assert got == [("f", 0, "bodypart0", 1.0, 2.0, 1.0), ("f", 0, "bodypart1", 4.0, 5.0, 1.0), ("f", 1, "bodypart0", 7.0, 8.0, 1.0), ("f", 1, "bodypart1", 1.0, 1.0, 1.0)]


def test_registry_files_names(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        load_keypoints(spark, "x", "none")
    register_format("mine", lambda s, p: s.range(1))
    assert load_keypoints(spark, "x", "mine").count() == 1
    del FORMATS["mine"]
    put(tmp_path / "d" / "e", "b.CSV", "x")
    put(tmp_path / "d", "a.csv", "x")
    put(tmp_path / "d", "a.txt", "x")
    files = list_files(spark, str(tmp_path / "d"), [".csv"])
    assert [r.n for r in files.select(recording_name("path").alias("n")).collect()] == ["a", "b"]
    long = files.select(recording_name("path", path_in_name=True, sep="-").alias("n")).collect()
    assert long[1].n.endswith("d-e-b")
    two = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "recording string, path string")
    assert [r.recording for r in overlapping_names(two).collect()] == ["a"]


def test_long_and_back(spark, tmp_path):
    df = frames(spark, [("r", 0, [[1.0, 2.0], [3.0, 4.0]], [0.5, 0.25]), ("r", 1, [[5.0, 6.0], [7.0, 8.0]], [1.0, 1.0])])
    sinks.save_keypoints_csv(df, str(tmp_path / "k"), ["nose", "tail"])
    back = to_frames(load_keypoints(spark, str(tmp_path / "k"), "keypoints"), ["nose", "tail"]).orderBy("frame").collect()
    assert [(r.pose, r.conf) for r in back] == [([[1.0, 2.0], [3.0, 4.0]], [0.5, 0.25]), ([[5.0, 6.0], [7.0, 8.0]], [1.0, 1.0])]


def test_results_guard(spark, tmp_path):
    p = str(tmp_path / "r")
    sinks.save_results(results(spark, [("a", 0, 1), ("b", 0, 2)]), p)
    with pytest.raises(ValueError, match="already saved: a"):
        sinks.save_results(results(spark, [("a", 0, 5)]), p)
    sinks.save_results(results(spark, [("a", 0, 5)]), p, overwrite=True)
    sinks.save_results(results(spark, [("c", 0, 7)]), p)
    assert {(r.recording, r.syllable) for r in spark.read.parquet(p).collect()} == {("a", 5), ("b", 2), ("c", 7)}
    sinks.save_results_csv(results(spark, [("a", 0, 5)]), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns[1] == "syllable"


def test_dimensions(spark):
    idx = spark.createDataFrame([("a", "g")], "name string, group string")
    assert {tuple(r) for r in sinks.updated_index(idx, results(spark, [("a", 0, 1), ("b", 0, 1)])).collect()} == {("a", "g"), ("b", "default")}
    movies = spark.createDataFrame([("m/syllable3.mp4",), ("m/other.txt",)], "path string")
    got = sinks.syllable_info(results(spark, [("a", 0, 1)]), movies).orderBy("syllable").collect()
    assert [(r.syllable, r.movie_path) for r in got] == [(1, ""), (3, "m/syllable3.mp4")]


def test_half_to_even(spark):
    df = results(spark, [("a", 0, 1)]).withColumns({"heading": F.lit(0.00005), "centroid": F.array(F.lit(0.00015), F.lit(2.0))})
    r = sinks.results_csv(df).first()
    assert (r["heading"], r["centroid x"]) == (0.0, 0.0002)


def test_config(tmp_path):
    p = str(tmp_path)
    config.write(p, bodyparts=["nose", "tail"], use_bodyparts=["tail", "nose"], anterior_bodyparts=["nose"], posterior_bodyparts=["tail"], extra=1)
    c = config.load(p)
    assert c["anterior_idxs"] == [1] and c["extra"] == 1
    config.change(p, fps=60)
    assert config.load(p)["fps"] == 60
    config.change(p, use_bodyparts=["ear"])
    with pytest.raises(ValueError, match="ear is no body part"):
        config.load(p)
