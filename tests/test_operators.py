"""Invariants and hand-worked values of the core operators."""

import numpy as np
import pytest
from fixtures import clash, frames, results
from pyspark.sql import functions as F

from gaitloom.operators import hypothesis, instances, model, sequence, signal
from gaitloom.operators.timeline import runs, states
from gaitloom.streaming import streams


def seq(spark, labels, rec="a"):
    return states(clash(results(spark, [(rec, i, s) for i, s in enumerate(labels)])))


def test_runs_and_frequencies_by_hand(spark):
    r = runs(seq(spark, [0, 0, 1, 1, 1, 2, 0])).orderBy("run").collect()
    assert [(x.syllable, x.start, x.end) for x in r] == [(0, 0, 2), (1, 2, 5), (2, 5, 6), (0, 6, 7)]
    f = {x.syllable: x.frequency for x in sequence.frequency(runs(seq(spark, [0, 0, 1, 1, 1, 2, 0]))).collect()}
    assert f == {0: 0.5, 1: 0.25, 2: 0.25}
    b = sequence.ngrams(runs(seq(spark, [0, 0, 1, 1, 1, 2, 0]))).collect()
    assert {(x.l1, x.l2, x.n) for x in b} == {(1, 2, 1), (2, 0, 1)}


def test_runs_across_chunks(spark):
    labels = [0] * 5000 + [1] + [0] * 4000
    r = runs(seq(spark, labels)).orderBy("run").collect()
    assert [(x.start, x.end) for x in r] == [(0, 5000), (5000, 5001), (5001, 9001)]


def test_nothing(spark):
    empty = seq(spark, [])
    assert runs(empty).count() == 0 and sequence.onsets(empty).count() == 0
    assert signal.interpolate(signal.keypoints(frames(spark, []))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_median_filter_reflects(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    df = seq(spark, [1] * n).withColumn("v", F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("pos").cast("int")))
    got = [r.filtered for r in signal.median_filter(df, "v", 9).orderBy("pos").collect()]
    padded = np.pad(v, 4, mode="symmetric")
    assert np.allclose(got, [np.median(padded[i : i + 9]) for i in range(n)])


def test_interpolation_by_hand(spark):
    df = frames(spark, [("a", i, [[x, 0.0]], [1.0]) for i, x in enumerate([None, 1.0, float("nan"), 3.0, None])] + [("b", 0, [[None, None]], [1.0])])
    got = {(r.recording, r.frame): r.x for r in signal.interpolate(signal.keypoints(df)).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("a", 4): 3.0, ("b", 0): 0.0}


def test_one_missing_value_does_not_disable_outliers(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(0, 1, (60, 3, 2)) + np.array([[0, 0], [10, 0], [20, 0]])
    p[30, 2] = (500, 500)
    rows = [("a", i, [[float(v) for v in c] for c in q], [1.0] * 3) for i, q in enumerate(p)]
    rows[10] = ("a", 10, [None, [10.0, 0.0], [20.0, 0.0]], [1.0] * 3)
    got = {(r.frame, r.kp) for r in signal.medoid_outliers(signal.poses(frames(spark, rows))).where("outlier").collect()}
    assert (30, 2) in got


def test_tests_by_hand(spark):
    v = spark.createDataFrame([("a", "1", 0, 1.0), ("a", "2", 0, 2.0), ("b", "3", 0, 3.0), ("b", "4", 0, 4.0)], "group string, name string, syllable int, value double")
    r = hypothesis.average_ranks(v)
    assert abs(hypothesis.kruskal(r).first().h - 2.4) < 1e-9
    assert abs(hypothesis.dunn(r).first().z - 1.5491933) < 1e-6
    t = hypothesis.permutation_test(r, n_perm=2000).where("a is null").first()
    assert abs(t.statistic - 2.4) < 1e-9 and 0 < t.p < 0.1
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "k int, p double").withColumn("all", F.lit(1))
    got = [round(x.p_adj, 9) for x in hypothesis.fdr(p, ["all"], tie=["k"]).orderBy("k").collect()]
    assert got == [0.02, 0.04, 0.04, 0.02]


def test_mapping_refuses_unknown_labels(spark):
    m = spark.createDataFrame([(0, 1)], "old int, new int")
    assert [r.syllable for r in sequence.relabel(seq(spark, [0, 0]), m).collect()] == [1, 1]
    with pytest.raises(Exception, match="missing from the mapping"):
        sequence.relabel(seq(spark, [0, 5]), m).collect()


def test_segment_length_by_hand():
    assert model.segment_length([8, 15, 5], 10_000, 50, 4) == 8


def test_model_recovers_states(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = [np.array([[0.9, 0.2], [-0.2, 0.9]]), np.array([[0.9, -0.4], [0.4, 0.7]])]
    rows, truth = [], []
    for seg in range(4):
        x, z = np.zeros((300, 2)), np.repeat(rng.integers(0, 2, 10), 30)
        for t in range(1, 300):
            x[t] = a[z[t]] @ x[t - 1] + np.array([0.5, -0.5]) * (1 - 2 * z[t]) + rng.normal(0, 0.05, 2)
        rows += [("r", seg * 300 + t, seg, [float(v) for v in x[t]]) for t in range(300)]
        truth += z.tolist()
    df = spark.createDataFrame(rows, "recording string, pos bigint, seg bigint, x array<double>").cache()
    h = model.update(model.Hyper(states=2, lags=1), kappa="20")
    p, trace = model.fit(df, h, 2, iterations=8, seed=3, save_every=4, folder=str(tmp_path / "s"))
    again, same = model.fit(df, h, 2, iterations=8, seed=3)
    assert trace == same and np.allclose(p.pi, again.pi) and np.allclose(p.pi.sum(1), 1) and all(np.linalg.eigvalsh(q).min() > 0 for q in p.q)
    assert trace[-1] > trace[0]
    back = model.load(spark, str(tmp_path / "s"), h)
    assert np.allclose(back.ab, p.ab) and model.load(spark, str(tmp_path / "s"), h, 4).pi.shape == (2, 2)
    assert model.snapshots(spark, str(tmp_path / "s")) == [4, 8]
    model.relabel_snapshots(spark, str(tmp_path / "s"), h, [1, 0])
    assert np.allclose(model.load(spark, str(tmp_path / "s"), h).ab, p.ab[::-1]) and np.allclose(model.load(spark, str(tmp_path / "s"), h).pi, p.pi[::-1, ::-1])
    assert model.truncate(spark, str(tmp_path / "s"), 4) == [8] and model.snapshots(spark, str(tmp_path / "s")) == [4]
    z = np.array([r.syllable for r in model.apply(df, p).orderBy("pos").collect()])
    agree = (z == np.array(truth)).mean()
    assert max(agree, 1 - agree) > 0.9
    m = np.array([r.marginal for r in model.state_marginals(df, p).collect()])
    assert np.allclose(m.sum(1), 1)
    e = {r.model: r.score for r in model.expected_likelihoods(df, [p, model.initial(h, 2, 5)]).collect()}
    assert e[0] > e[1]
    with pytest.raises(ValueError):
        model.update(h, nothing=1)


def test_stream_of_runs(spark, tmp_path):
    for part in ([("a", 0, 1), ("a", 1, 1), ("b", 0, 2)], [("a", 2, 1), ("a", 3, 4), ("b", 1, None), ("b", 2, 2)], [("b", 3, 5), ("a", 4, 4)]):
        results(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streams.run_to_table(streams.stream_runs(streams.state_stream(spark, str(tmp_path / "in")), late=0), checkpoint=str(tmp_path / "c"))
    assert {tuple(r) for r in streams.with_state_store(spark, run).collect()} == {("a", 1, 0, 2, 3), ("b", 2, 0, 2, 2)}


def stream_parts(rng):
    """Rows of two recordings, delivered out of order, with repeats and corrections in later files."""
    from fixtures import T0, T1

    truth = [(r, f, int(f // 7 % 3) if f % 11 else None) for r in "ab" for f in range(10, 130)]
    parts = [[] for _ in range(5)]
    for r, f, s in truth:
        at = min((f - 10) // 24, 4)
        if rng.random() < 0.2 and at < 4:
            parts[at].append((r, f, 9, T0))  # wrong at first, corrected in the next file
            parts[at + 1].append((r, f, s, T1))
        else:
            parts[min(at + int(rng.random() < 0.2), 4)].append((r, f, s, T0))  # some come a file late
            if rng.random() < 0.1:
                parts[4].append((r, f, 8, None))  # an older version, very late
    for p in parts:
        rng.shuffle(p)
    return truth, parts


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    truth, parts = stream_parts(np.random.default_rng(4))
    want, late = set(), 48
    for rec in "ab":
        seq = [(f, s) for r, f, s in truth if r == rec and f <= 129 - late and s is not None]
        runs = []
        for f, s in seq:
            if runs and runs[-1][1] == s:
                runs[-1][3:] = [f, runs[-1][4] + 1]
            else:
                runs.append([rec, s, f, f, 1])
        want |= {tuple(x) for x in runs[:-1]}
    for name, files in (("many", parts), ("one", [sum(parts, [])])):
        for i, part in enumerate(files):
            results(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        run = lambda: streams.run_to_table(streams.stream_runs(streams.state_stream(spark, str(tmp_path / name)), late), checkpoint=str(tmp_path / f"c_{name}"))  # noqa: B023, E731
        assert {tuple(r) for r in streams.with_state_store(spark, run).collect()} == want


def test_idle_recordings_are_closed(spark, tmp_path):
    import time

    results(spark, [("a", 0, 1), ("a", 1, 1), ("a", 2, 3)]).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        runs = streams.stream_runs(streams.state_stream(spark, str(tmp_path / "in")), late=100, idle=500)
        w = runs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds")
        q, got, end = w.start(), [], time.time() + 60
        try:
            while not got and time.time() < end:
                time.sleep(1)
                got = spark.read.schema(streams.RUN_SCHEMA).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        finally:
            q.stop()
        return got

    assert {tuple(r) for r in streams.with_state_store(spark, run)} == {("a", 1, 0, 1, 2), ("a", 3, 2, 2, 1)}


def test_stream_filter_over_batches_of_any_size(spark, tmp_path):
    h = model.Hyper(states=3, lags=3)
    p = model.initial(h, 1, 1)
    x = np.random.default_rng(3).normal(size=(12, 1))
    a, _ = model.forward(p, model.log_likelihoods(p, x))
    schema = "recording string, frame bigint, x array<double>, loaded_at timestamp"
    for sizes in ((1, 2, 1, 5, 3), (12,)):
        folder, at = str(tmp_path / f"in{len(sizes)}"), 0
        for n in sizes:
            spark.createDataFrame([("r", i, [float(v) for v in x[i]], None) for i in range(at, at + n)], schema).coalesce(1).write.mode("append").parquet(folder)
            at += n
        run = lambda: streams.run_to_table(streams.stream_filter(streams.state_stream(spark, folder), p, late=0))  # noqa: B023, E731
        got = sorted(tuple(r) for r in streams.with_state_store(spark, run).collect())
        assert [(f, s) for _, f, s, _ in got] == [(i + 3, int(a[i].argmax())) for i in range(9)]
        assert np.allclose([q for *_, q in got], a.max(1))


def test_clustering():
    from gaitloom.operators.clustering import leaf_order, linkage

    d = np.abs(np.subtract.outer([0.0, 1.0, 10.0, 12.0], [0.0, 1.0, 10.0, 12.0]))
    m = linkage(d)
    assert [(a, b, h) for a, b, h, _ in m] == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 12.0)] and leaf_order(m, 4) == [0, 1, 2, 3]
    assert linkage(d, "single")[-1][2] == 9.0 and linkage(d, "average")[-1][2] == 10.5


def test_reconstruction(spark):
    df = spark.createDataFrame([([2.0], [10.0, 20.0], float(np.pi / 2))], "x array<double>, v array<double>, h double")
    pose = model.reconstruct(df, np.array([[1.0, 0.5], [0.0, 1.0]]), 1).first().pose
    assert np.allclose(pose, [[10 - 1.0, 20 + 2.5]])


def test_local_density_counts_every_vector_of_the_label(spark):
    rng = np.random.default_rng(4)
    v, labels = rng.normal(size=(300, 3)), np.r_[np.zeros(240, int), np.ones(58, int), [2, 2]]
    df = spark.createDataFrame([(i, int(k), [float(c) for c in x]) for i, (k, x) in enumerate(zip(labels, v))], "id bigint, label int, v array<double>")
    for cut in ({}, {"block": 64}):
        got = {r.label: r for r in instances.density_exemplars(df, neighbours=10, dims=3, sample=20, **cut).collect()}
        assert sorted(got) == [0, 1, 2]
        for k, r in got.items():
            d = np.sort(np.linalg.norm(v[labels == k] - v[r.id], axis=1))[:10]
            assert abs(r.local - 1 / d.mean()) < 1e-9


def test_melt_holds_every_label(spark, sf, duck):
    from gaitloom.plans import reference

    labels = {f"s{r[0]}" for r in duck.sql("select distinct syllable from results where recording is not null and frame is not null and syllable is not null").fetchall()}
    got = {r.variable for r in reference.QUERIES["melt_stats_all"](spark, sf).select("variable").distinct().collect()}
    assert len(got) > 3 and got <= labels and got == {f"s{r.syllable}" for r in reference.QUERIES["pivot_stats"](spark, sf).select("syllable").distinct().collect()}


def test_permutations_by_brute_force_and_blocks(spark):
    rng = np.random.default_rng(8)
    group = np.array(["a"] * 7 + ["b"] * 9 + ["c"] * 5)
    value = np.round(rng.normal(size=(21, 3)) + (group == "b")[:, None] * np.array([1.5, 0.0, 0.4]), 1)
    rows = [(g, f"r{i}", s, float(value[i, s])) for i, g in enumerate(group) for s in range(3)]
    r = hypothesis.average_ranks(spark.createDataFrame(rows, "group string, name string, syllable int, value double"))
    runs = [{(x.syllable, x.a, x.b): (x.statistic, x.p) for x in hypothesis.permutation_test(r, n_perm=2000, chunk=c, block=b).collect()} for c, b in ((500, 20_000), (500, 4))]
    assert len(runs[0]) == 12 and all(np.allclose(runs[0][k], runs[1][k]) for k in runs[0])  # blocks of recordings change nothing
    h, z = {x.syllable: x.h for x in hypothesis.kruskal(r).collect()}, {(x.syllable, x.a, x.b): x.z for x in hypothesis.dunn(r).collect()}
    rk = {(x.name, x.syllable): x.rk for x in r.collect()}
    for s in range(3):
        ranks = np.array([rk[f"r{i}", s] for i in range(21)])
        assert np.isclose(runs[0][s, None, None][0], h[s])
        ssb = lambda v, g: sum(v[g == q].sum() ** 2 / (g == q).sum() for q in np.unique(g))
        null = np.array([ssb(rng.permutation(ranks), group) for _ in range(4000)])
        assert abs(runs[0][s, None, None][1] - (null > ssb(ranks, group) + 1e-9).mean()) < 0.04
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            assert np.isclose(runs[0][s, a, b][0], z[s, a, b])
            both, own = ranks[(group == a) | (group == b)], group[(group == a) | (group == b)]
            gap = lambda v: abs(v[own == a].mean() - v[own == b].mean())  # noqa: B023, E731
            null = np.array([gap(rng.permutation(both)) for _ in range(4000)])
            assert abs(runs[0][s, a, b][1] - (null > gap(both) + 1e-9).mean()) < 0.04


def test_queries_permute_ten_thousand_times(spark, sf):
    from gaitloom.plans import reference

    p = [r.p for r in reference.QUERIES["permutation_pvalue"](spark, sf).collect()]
    assert any(abs(x * 1000 - round(x * 1000)) > 1e-6 for x in p) and all(abs(x * 10_000 - round(x * 10_000)) < 1e-6 for x in p)


def test_model_queries_use_a_whole_fit(spark, sf):
    from gaitloom.plans import reference

    trace = [r.log_likelihood for r in reference.QUERIES["arhmm_fit"](spark, sf).orderBy("iteration").collect()]
    assert len(trace) == 50 and trace[-1] > trace[0]
    assert len(reference.QUERIES["state_marginals"](spark, sf).first().marginal) == 100


def test_sweep_draws_as_single_segments_do():
    rng, p = np.random.default_rng(2), model.initial(model.Hyper(states=5, lags=2), 2, 3)
    xs = [rng.normal(size=(n, 2)) for n in (4, 30, 17)]
    got = model._sweep(p, xs, [np.random.default_rng(i) for i in range(3)])
    z = [model.sample_states(p, x, np.random.default_rng(i)) for i, x in enumerate(xs)]
    trans = np.zeros((5, 5))
    for s in z:
        np.add.at(trans, (s[:-1], s[1:]), 1)
    assert np.array_equal(got[:25].reshape(5, 5), trans)
    assert abs(got[-1] - sum(model.forward(p, model.log_likelihoods(p, x))[1] for x in xs)) < 1e-8


def test_stream_filter_takes_the_latest_row_of_a_frame(spark, tmp_path):
    from fixtures import T0, T1

    h = model.Hyper(states=2, lags=1)
    once = [("a", i, [float(i % 3)], T1) for i in range(6)]
    again = [("a", 2, [9.0], T0), ("a", 3, [0.0], T1), ("a", 4, [7.0], None)]
    got = []
    for k, rows in enumerate((once, once + again)):
        spark.createDataFrame(rows, "recording string, frame bigint, x array<double>, loaded_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        run = lambda: streams.run_to_table(streams.stream_filter(streams.state_stream(spark, str(tmp_path / f"in{k}")), model.initial(h, 1, 1), late=0))  # noqa: B023, E731
        got.append(sorted(tuple(r) for r in streams.with_state_store(spark, run).collect()))
    assert got[0] == got[1] and len(got[0]) == 5


def test_likelihoods_over_the_latents_of_other_models(spark):
    rng = np.random.default_rng(5)
    h = model.Hyper(states=2, lags=1)
    models = [model.initial(h, 2, k) for k in range(3)]
    xs = [[rng.normal(size=(n, 2)) for n in sizes] for sizes in ((20, 5), (9,), (12, 30))]
    dfs = [spark.createDataFrame([("r", i, t, [float(v) for v in row]) for i, x in enumerate(s) for t, row in enumerate(x)], "recording string, seg bigint, pos bigint, x array<double>") for s in xs]
    got = {r.model: r for r in model.cross_likelihoods(dfs, models).collect()}
    for i, m in enumerate(models):
        ll = [sum(model.forward(m, model.log_likelihoods(m, x))[1] for x in xs[j]) for j in range(3) if j != i]
        assert abs(got[i].score - np.mean(ll)) < 1e-8 and abs(got[i].standard_error - np.std(ll) / np.sqrt(2)) < 1e-8
