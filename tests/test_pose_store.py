import numpy as np
from fixtures import T1, frames

from gaitloom.operators import formatting, model
from gaitloom.operators import pose_store as S
from pyspark.sql import functions as F


def poses(rng):
    """Short and long recordings over block ends, corrections, outliers, missing and ragged poses, two rows alone."""
    rows = []
    for rec, ts in (("long", range(4000, 4160)), ("wide", [*range(8180, 8200), *range(12280, 12300)]), ("short", range(70)), ("two", range(2))):
        for t in ts:
            p = np.round(rng.normal(100, 20, (3, 2)) + t % 50, 2).tolist()
            c = np.round(rng.random(3), 3).tolist()
            if t % 17 == 3:
                p[1] = [9000.0, 9000.0]
            if t % 13 == 4:
                p[2] = [float("nan"), 1.0]
            rows.append((rec, t, p, c))
        rows += [(rec, ts[1], [[1.0, 2.0], [3.25, 4.0], [9.0, 5.0]], [1.0, 0.5, None], T1), (rec, None, p, c), (None, 5, p, c)]
    none = [(r[0], r[1], None if r[1] % 2 else r[2], r[3]) if r[0] == "wide" and r[1] and 8190 < r[1] < 12285 else r for r in rows]
    return none + [("short", 90, [], []), ("short", 91, None, None)]


def test_batches_hold_what_the_formatting_gives(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST", 60)
    f, use = frames(spark, poses(np.random.default_rng(0))), [0, 1, 2]
    store = S.build(f, use, [0], [2], size=50, lags=2)
    got = {}
    for b in store.batches:
        g, at = S._load(store.folder, f"y-{b}"), 0
        for rec, seg, skip, n in zip(g["recording"], g["seg"], g["skip"], g["size"]):
            got[rec.decode(), int(seg)] = (int(skip), g["frames"][at : at + n], g["y"][at : at + n], g["level"][g["conf"][at : at + n]])
            at += n
    want = formatting.format_data(f, use, 50, lags=2, outliers=6.0).groupBy("recording", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "frame", "context", "x", "y", "conf"))).alias("r"))
    want = {(r.recording, r.seg): r.r for r in want.collect() if len(r.r) > 3}
    short = lambda k: k[0] == "short"
    assert {k for k in got if not short(k)} == {k for k in want if not short(k)} and len(store.batches) > 2
    assert sum(len(q[1]) - q[0] for k, q in got.items() if short(k)) == 70
    for key, r in want.items():
        if not short(key):
            skip, frame, y, conf = got[key]
            assert skip == sum(x.context for x in r) and frame.tolist() == [x.frame for x in r]
            assert np.allclose(y, np.array([[x.x, x.y] for x in r]).transpose(0, 2, 1), atol=1e-9) and np.array_equal(conf, np.array([x.conf for x in r]))
    v = formatting.pca_fit(formatting.aligned(formatting.cleaned(f, use, 6.0), [0], [2]), "v", 6)
    assert np.allclose(v.mean, store.pca.mean) and np.allclose(v.components[:5], store.pca.components[:5], atol=1e-6)  # the sixth has no variance


def test_every_frame_gets_a_result(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST", 60)
    f = frames(spark, poses(np.random.default_rng(1)))
    store = S.build(f, [0, 1, 2], [0], [2], lags=2)
    p, last = S.fit(S.start(store, model.Hyper(states=4, lags=2), 2), store, iterations=3)
    rows = S.extract(p, store, last).collect()
    assert len(p.trace) == 3 and np.isfinite(p.trace).all()
    assert sorted((r.recording, r.frame) for r in rows) == sorted({(r[0], r[1]) for r in poses(np.random.default_rng(1)) if None not in r[:2] and r[0] != "two" and r[1] not in (90, 91) or r[0] == "short" and r[1] is not None and r[1] < 70})
    assert all(len(r.latent_state) == 2 and len(r.centroid) == 2 and 0 <= r.syllable < 4 for r in rows)
    empty = S.build(f.limit(0), [0, 1, 2], [0], [2], lags=2)
    assert S.extract(S.start(empty, model.Hyper(states=4, lags=2), 2), empty, None).count() == 0


def test_packed_values_come_back_exactly():
    rng = np.random.default_rng(2)
    for a in (rng.normal(size=(7, 3)), np.round(rng.normal(300, 50, (50, 4)), 2), np.array([[-0.0, np.nan], [1e9, 0.1]]), np.full((3, 2), np.nan), np.empty((4, 0))):
        b = S.decode(S.encode(a), *a.shape)
        assert np.array_equal(a, b, equal_nan=True) and np.array_equal(np.signbit(a), np.signbit(b))


def test_joined_states_are_drawn_from_their_posterior():
    """Segments of several lengths by step, in single precision, against the marginals; far jumps are left to double precision."""
    rng = np.random.default_rng(3)
    p = model.initial(model.Hyper(states=3, lags=2), 2, 0)
    for jump in (0.0, 60.0):
        cut = [9, 6, 12]
        xs = [np.cumsum(rng.normal(size=(n, 2)), 0) for n in cut]
        xs[2][6:] += jump
        z = model.draw_joined(p, np.concatenate(xs * 3000), np.tile(cut, 3000), np.random.default_rng(4)).reshape(3000, -1)
        want = np.concatenate([model.marginals(p, x) for x in xs])
        assert np.abs(np.stack([(z == k).mean(0) for k in range(3)], 1) - want).max() < 0.05
    both = model.designs(np.concatenate(xs), np.array(cut), 2)
    at = np.r_[0, np.cumsum(np.array(cut) - 2)[:-1]]
    assert np.allclose(model.joined_sums(both, 2, z[0], at, 3), model.sums(both[:, :5], both[:, 5:], z[0], at, 3))
