import numpy as np
import pytest
from fixtures import T0, T1, clash, frames
from pyspark.sql import functions as F

from gaitloom.operators import formatting as D
from gaitloom.operators import instances, model
from gaitloom.sources import loaders, sinks, videos


def test_format_data_by_hand(spark):
    rows = [("a", f, [[float(f), 1.0], None if f == 1 else [2.0, 2.0 * f]], [0.5, -1.0]) for f in (0, 1, 2, 3, 5)] + [("a", 2, [[99.0, 99.0]] * 2, [0.1, 0.1], None), ("b", 0, None, None), (None, 0, None, None)]
    got = D.format_data(clash(frames(spark, rows)), [1, 0], 2, lags=1, noise=0.0).orderBy("recording", "seg", "pos").collect()
    assert [(r.seg, r.pos, r.frame, r.context) for r in got] == [(0, 0, 0, False), (0, 1, 1, False), (1, 1, 1, True), (1, 2, 2, False), (1, 3, 3, False), (2, 3, 3, True), (2, 4, 5, False)]
    one = got[1]
    assert one.x == [2.0, 1.0] and one.y == [2.0, 1.0] and np.allclose(one.conf, [0.001, 0.501])  # frame 1, interpolated
    assert D.unbatch(D.format_data(frames(spark, rows), [0, 1], 2, lags=1)).count() == 5
    assert D.format_data(frames(spark, []), [0], 10).count() == 0


def test_noise_is_the_same_wherever_it_is_drawn(spark):
    rows = frames(spark, [("a", f, [[1.0, 2.0]], [1.0]) for f in range(50)])
    a, b = (D.format_data(x, [0], 10).where("not context").orderBy("pos").collect() for x in (rows, rows.repartition(7)))
    assert [r.x for r in a] == [r.x for r in b] and 0 < max(abs(r.x[0] - 1) for r in a) <= 0.1


def test_pca_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(5)
    p = D.pca_fit(df, "v", 4)
    value = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(p.variance, value) and np.allclose(p.mean, x.mean(0))
    got = {r.id: r.latent for r in D.pca_project(df, "v", p, 2).collect()}
    assert got[999] is None and np.allclose([got[i] for i in range(300)], (x - x.mean(0)) @ p.components[:2].T)
    D.pca_save(spark, p, str(tmp_path / "pca"))
    q = D.pca_load(spark, str(tmp_path / "pca"))
    assert np.allclose(q.components, p.components) and np.allclose(q.variance, p.variance) and np.allclose(q.mean, p.mean)
    up = {(r.component, r.sign, r.kp): (r.x, r.y) for r in D.pca_shapes(spark, p, 2, 2.0).collect()}
    assert np.allclose(up[1, 1, 0], (p.mean + 2 * np.sqrt(p.variance[1]) * p.components[1])[:2])
    assert model.variance_explained(df, "v", 4).count() == 4 and model.variance_explained(df.where("id < 0"), "v", 4).count() == 4


def test_fitted_model_on_projected_poses(spark):
    """Poses to latents to a fit to its application: the chain runs and tells the two behaviours apart."""
    rng, rows = np.random.default_rng(1), []
    base = np.stack([np.arange(4) * 10.0, np.arange(4) % 2 * 4.0], -1)
    for t in range(400):
        s = t // 50 % 2
        shape = base * (1 + 0.3 * s * np.sin(t / 2)) + rng.normal(0, 0.05, (4, 2))
        rows.append(("m", t, [[float(v) for v in p] for p in shape + (100, 100)], [1.0] * 4))
    v = D.aligned(D.cleaned(frames(spark, rows), [0, 1, 2, 3]), [3], [0])
    lat = D.pca_project(v, "v", D.pca_fit(v, "v", 8), 2).select("recording", F.col("frame").alias("pos"), F.lit(0).alias("seg"), F.col("latent").alias("x"))
    h = model.Hyper(states=4, lags=1, kappa=50.0)
    p, trace = model.fit(lat, h, 2, iterations=15, seed=3)
    assert trace[-1] > trace[0]
    z = np.array([r.syllable for r in model.apply(lat, p).orderBy("pos").collect()])
    truth = np.arange(400)[-len(z):] // 50 % 2
    best = sum(max(np.bincount(truth[z == k], minlength=2)) for k in np.unique(z)) / len(z)
    assert best > 0.8


def test_whole_vectors_and_density_sample(spark):
    rng, rows = np.random.default_rng(2), []
    for s in range(2):
        for i in range(30):
            c = rng.normal(0, 0.2 if i < 12 else 3.0, 2) + (s * 1.0, 0)
            rows += [(f"r{s}", s, i * 10, rel, [float(c[0] + rel), None if i == 0 and rel == 0 else float(c[0])], [float(c[1]), None if i == 0 and rel == 0 else 1.0]) for rel in (-1, 0)]
    t = spark.createDataFrame(rows, "recording string, syllable int, start int, rel int, x array<double>, y array<double>")
    v = instances.whole_vectors(t, 1, 1, 2).orderBy("label", "start").collect()
    first = v[0].v
    assert len(v) == 60 and len(first) == 8 and first[4] == first[5] and first[7] == 1.0  # the missing cell took the frame before
    got = instances.density_sample(spark.createDataFrame([(r.id, r.label, r.v) for r in v], "id bigint, label int, v array<double>"), 8, 8, dims=2, block=16).collect()
    # brute force in the same projection
    x, label, ids = np.array([r.v for r in v]), np.array([r.label for r in v]), np.array([r.id for r in v])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    q = (x - x.mean(0)) @ axes
    d = np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1))
    for k in (0, 1):
        own = np.flatnonzero(label == k)
        local = 1 / np.sort(d[np.ix_(own, own)], 1)[:, :8].mean(1)
        everywhere = 1 / np.sort(d[own], 1)[:, :8].mean(1)
        ratio = np.round(local / everywhere, 9)
        e = min(own[ratio == ratio.max()], key=lambda i: ids[i])  # ties fall to the smaller id
        want = set(ids[own[np.argsort(d[e, own])[:8]]].tolist())
        assert {r.id for r in got if r.label == k} == want
    assert instances.typical_dense(t, 1, 1, 2, n=8, dims=2).count() == 2 * 2 * 2
    assert instances.typical_dense(t, 1, 1, 2, n=31, dims=2).count() == 0


def test_videos(spark):
    rec = spark.createDataFrame([("x/ab_1",), ("abc_2",), (None,)], "recording string")
    vid = spark.createDataFrame([("/v/ab.mp4",), ("/v/abc.avi",), ("/v/a.mov",)], "path string")
    assert {tuple(r) for r in videos.match_videos(rec, vid, "_").collect()} == {("x/ab_1", "/v/ab.mp4"), ("abc_2", "/v/abc.avi")}
    with pytest.raises(Exception, match="no video for"):
        videos.match_videos(rec, vid.where("path like '%abc%'"), "_").collect()
    loose = videos.match_videos(rec, vid.where("path like '%abc%'"), "_", strict=False)
    assert [r.recording for r in videos.without_video(rec.where("recording is not null"), loose).collect()] == ["x/ab_1"]


def test_loaders_refuse_what_does_not_fit(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "one.csv").write_text("nose_x,nose_y\n1,2\n")
    with pytest.raises(ValueError, match="one name, several files"):
        loaders.load_keypoints(spark, str(tmp_path), "keypoints")
    assert loaders.load_keypoints(spark, str(tmp_path), "keypoints", path_in_name=True).count() == 2
    long = spark.createDataFrame([("r", 0, "nose", 1.0, 1.0, None, 1.0), ("r", 0, "tail", None, 1.0, None, 1.0), ("q", 0, "nose", float("nan"), 1.0, None, 1.0)], loaders.LONG)
    with pytest.raises(ValueError, match="q lacks tail"):
        loaders.to_frames(long, ["nose", "tail"])
    assert {(r.bodypart, r.missing, r.much) for r in loaders.missing_share(long).collect()} == {("nose", 0.5, False), ("tail", 1.0, True)}
    with pytest.raises(ValueError, match="no body part"):
        loaders.reindex(frames(spark, []), ["nose"], ["ear"])


def test_sinks_again(spark, tmp_path):
    bad = tmp_path / "out"
    bad.mkdir()
    (bad / "x.parquet").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017
        sinks.save_results(spark.createDataFrame([("r", 0)], "recording string, frame int"), str(bad))
    t = {"a": spark.range(3), "b": spark.range(5)}
    sinks.save_tables(t, str(tmp_path / "t"))
    assert {n: x.count() for n, x in sinks.load_tables(spark, str(tmp_path / "t"), ["a", "b"]).items()} == {"a": 3, "b": 5}
    notes = spark.createDataFrame([("k", 0, 5, "nose", 1.0, 2.0)], "key string, coordinate_index int, video_frame_index int, bodypart string, x double, y double")
    sinks.save_annotations(notes, str(tmp_path / "n"), ["made by hand"])
    lines = "".join(p.read_text() for p in (tmp_path / "n").glob("part*")).splitlines()
    assert lines == ["# made by hand", "key,coordinate_index,video_frame_index,bodypart,x,y", "k,0,5,nose,1.0,2.0"]
    assert loaders.read_table(spark, str(tmp_path / "n")).schema["x"].dataType.typeName() == "double"
    p = model.initial(model.Hyper(states=3, lags=1), 1, 0)
    model.save(spark, p, str(tmp_path / "snap"), 4)
    z = spark.createDataFrame([(4, "r", 0, 2), (4, "r", 1, 0)], "iter int, recording string, pos int, syllable int")
    new = model.relabel_snapshots(spark, str(tmp_path / "snap"), p.hyper, [2, 0, 1], z)
    assert [r.syllable for r in new.orderBy("pos").collect()] == [0, 1]
    assert np.allclose(model.load(spark, str(tmp_path / "snap"), p.hyper).ab, p.ab[[2, 0, 1]])


def test_density_draws_no_vectors_to_the_driver(spark, monkeypatch):
    """The drawn vectors stay with the tasks: the driver sees sums and projections, and the result is the one of all pairs."""
    import hashlib

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * [9, 7, 5, 1, 1, 1] + np.repeat(rng.normal(size=(3, 6)) * 4, 100, 0)
    df, got = spark.createDataFrame([(i, i // 100, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, label int, v array<double>"), []
    for name in ("collect", "toPandas"):
        whole = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda d, w=whole: got.append(d.columns) or w(d))
    best = instances.density_exemplars(df, neighbours=10, dims=3, sample=120, seed=4, block=40)
    assert got and not any("v" in c for c in got)
    drawn = sorted(range(300), key=lambda i: hashlib.md5(f"4-{i}".encode()).hexdigest())[:120]
    mean = x[drawn].mean(0)
    q = (x - mean) @ np.linalg.svd(x[drawn] - mean)[2][:3].T
    near = lambda a, b: np.sort(np.linalg.norm(a[:, None] - b[None], axis=2), 1)[:, :10].mean(1)
    for r in best.collect():
        own = slice(r.label * 100, r.label * 100 + 100)
        local, overall = 1 / near(q[own], q[own]), 1 / near(q[own], q[drawn])
        i = (local / overall).argmax()
        assert r.id == r.label * 100 + i and r.local == pytest.approx(local[i]) and r.overall == pytest.approx(overall[i])


def test_nearest_by_leaves_is_exact():
    rng = np.random.default_rng(6)
    for n, m, k in ((700, 900, 10), (5, 3, 10), (0, 3, 2), (300, 400, 50)):
        a, b = np.round(rng.normal(size=(n, 3)), 1), np.round(rng.normal(size=(m, 3)), 1)
        want = np.sort(np.sqrt(sum((a[:, j, None] - b[None, :, j]) ** 2 for j in range(3))), 1)[:, :k]
        assert np.array_equal(instances._nearest(a, b, k), want)
