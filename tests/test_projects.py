import pytest

from gaitloom.sources import config, projects


def test_projects_from_trackers(tmp_path):
    (tmp_path / "dlc.yaml").write_text("project_path: /data/p\nmultianimalproject: true\nbodyparts: MULTI!\nmultianimalbodyparts: [nose, tail, ear]\nskeleton: [[nose, tail]]\n")
    c = projects.create(str(tmp_path / "a"), "deeplabcut", str(tmp_path / "dlc.yaml"), anterior_bodyparts=["nose"], posterior_bodyparts=["tail"], fps=60)
    assert c["use_bodyparts"] == ["nose", "tail", "ear"] and c["skeleton"] == [["nose", "tail"]] and c["video_dir"] == "/data/p/videos"
    assert c["anterior_idxs"] == [0] and c["posterior_idxs"] == [1] and c["fps"] == 60 and c["nlags"] == 3
    with pytest.raises(FileExistsError):
        projects.create(str(tmp_path / "a"))
    assert projects.create(str(tmp_path / "a"), overwrite=True)["bodyparts"] == []
    (tmp_path / "f.json").write_text('{ // the skeleton\n "keypoints": [["no//se", 1], ["tail", 2], ["ear", 3]], /* pairs\n */ "limbs": [[[0, 1], "r"], [[[2], 0], "g"], [[1, 0], "b"]]}')
    c = projects.create(str(tmp_path / "b"), "freipose", str(tmp_path / "f.json"))
    assert c["bodyparts"] == ["no//se", "tail", "ear"] and c["skeleton"] == [["ear", "no//se"], ["no//se", "tail"]]


def test_projects_refuse_what_does_not_fit(tmp_path):
    (tmp_path / "empty.yaml").write_text("")
    with pytest.raises(ValueError, match="no project"):
        projects.create(str(tmp_path / "p"), "deeplabcut", str(tmp_path / "empty.yaml"))
    with pytest.raises(ValueError, match="unknown tracker"):
        projects.create(str(tmp_path / "p"), "other", "x")
    with pytest.raises(ValueError, match="belong together"):
        projects.create(str(tmp_path / "p"), "freipose")
    with pytest.raises(ValueError, match="in use"):
        projects.create(str(tmp_path / "p"), bodyparts=["a", "b"], use_bodyparts=["a"], anterior_bodyparts=["b"])
    config.write(str(tmp_path / "q"), bodyparts=["a"], use_bodyparts=["a"])
    assert config.load(str(tmp_path / "q"))["bodyparts"] == ["a"]
