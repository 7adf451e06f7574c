import numpy as np
import pytest

from gaitloom.operators import formatting, model
from gaitloom.operators import pose_model as P


def toy(rng, t=7, b=6000, k=3, d=2, lags=2, states=2):
    h = model.Hyper(states=states, lags=lags)
    ab = np.stack([np.c_[0.4 * np.eye(d), (0.3 + 0.2 * s) * np.eye(d), np.full((d, 1), 0.1 * s)] for s in range(states)])
    ar = model.Params(np.full((states, states), 1 / states), ab, np.stack([(0.2 + 0.1 * s) * np.eye(d) for s in range(states)]), h)
    p = P.PoseParams(ar, rng.normal(size=(2 * k, d + 1)), rng.uniform(0.5, 1.5, k), 0.3)
    y, v, ang, s = rng.normal(size=(t, k, 2)), rng.normal(size=(t, 2)), rng.normal(size=t), rng.uniform(0.5, 2, (t, k))
    z = rng.integers(0, states, t - lags)
    rep = lambda a: np.tile(a, (b, *([1] * a.ndim)))
    return p, [y, v, ang, s, z], [rep(a) for a in (y, v, ang, s, z)]


def test_latents_have_the_exact_posterior():
    rng = np.random.default_rng(0)
    p, (y, v, ang, s, z), many = toy(rng)
    t, k, d, lags = 7, 3, 2, 2
    # joint precision of all latent states, written out
    J, H = np.zeros((t * d, t * d)), np.zeros(t * d)
    J[: lags * d, : lags * d] += np.eye(lags * d) / P.FIRST
    for i in range(lags, t):
        a = p.ar.ab[z[i - lags]]
        row = np.zeros((d, t * d))
        row[:, i * d : (i + 1) * d] = np.eye(d)
        row[:, (i - lags) * d : i * d] = -a[:, :-1]
        q = np.linalg.inv(p.ar.q[z[i - lags]])
        J += row.T @ q @ row
        H += row.T @ q @ a[:, -1]
    for i in range(t):
        o = P._turn(y[i] - v[i], -ang[i]).ravel() - p.loadings[:, -1]
        w, c = np.diag(np.repeat(1 / (s[i] * p.sigmasq), 2)), p.loadings[:, :-1]
        sl = slice(i * d, (i + 1) * d)
        J[sl, sl] += c.T @ w @ c
        H[sl] += c.T @ w @ o
    cov = np.linalg.inv(J)
    x = P.draw_latents(p, *many, np.random.default_rng(1)).reshape(6000, -1)
    assert np.abs(x.mean(0) - cov @ H).max() < 5 * np.sqrt(np.diag(cov).max() / 6000)
    assert np.abs(np.cov(x.T) - cov).max() < 0.12 * np.diag(cov).max()


def test_centroids_have_the_exact_posterior():
    rng = np.random.default_rng(2)
    p, (y, v, ang, s, z), (yy, _, aa, ss, _) = toy(rng)
    x = rng.normal(size=(7, 2))
    prec = (1 / (s * p.sigmasq)).sum(1)
    mean = ((1 / (s * p.sigmasq))[..., None] * (y - P._turn(P.shapes(p, x), ang))).sum(1) / prec[:, None]
    step = np.eye(7) - np.eye(7, k=-1)
    cov = np.linalg.inv(np.diag(prec) + step[1:].T @ step[1:] / p.sigmasq_loc)
    want = cov @ (prec[:, None] * mean)
    got = P.draw_centroids(p, yy, np.tile(x, (6000, 1, 1)), aa, ss, np.random.default_rng(3))
    assert np.abs(got.mean(0) - want).max() < 5 * np.sqrt(np.diag(cov).max() / 6000)
    assert np.abs(np.cov(got[..., 0].T) - cov).max() < 0.12 * np.diag(cov).max()


def test_headings_by_density():
    rng = np.random.default_rng(4)
    p, (y, v, ang, s, z), (yy, vv, _, ss, _) = toy(rng)
    x = rng.normal(size=(7, 2))
    got = P.draw_headings(p, yy, np.tile(x, (6000, 1, 1)), vv, ss, np.random.default_rng(5))
    grid = np.linspace(-np.pi, np.pi, 2000, endpoint=False)
    for i in range(7):
        r = ((y[i] - v[i] - P._turn(np.tile(P.shapes(p, x[i]), (2000, 1, 1)), grid)) ** 2).sum(-1)
        w = np.exp(-0.5 * (r / (s[i] * p.sigmasq)).sum(-1))
        want = (w * np.exp(1j * grid)).sum() / w.sum()
        assert abs(np.exp(1j * got[:, i]).mean() - want) < 0.06


def test_weights_follow_the_counts():
    h = model.Hyper(states=4, kappa=1.0, gamma=10.0)
    trans = np.zeros((4, 4))
    trans[:, 0], trans[:, 1] = 5000, 20
    got = np.mean([model.draw_weights(h, trans, np.full(4, 0.25), np.random.default_rng(i)) for i in range(200)], 0)
    assert got[0] > got[1] > got[2] and np.isclose(got.sum(), 1)


def test_chain_from_frames_to_results(spark):
    """Poses with two behaviours and outliers: the fit lowers the residuals, tells the behaviours apart and gives every frame a result."""
    from fixtures import frames

    rng, rows, truth = np.random.default_rng(6), [], []
    base = np.stack([np.arange(4) * 10.0, np.arange(4) % 2 * 4.0], -1)
    base -= np.median(base, 0)
    c, turn = np.zeros(2) + 200, 0.0
    for t in range(360):
        s = t // 45 % 2
        truth.append(s)
        c, turn = c + rng.normal(0, 0.5, 2), turn + rng.normal(0, 0.03)
        shape = base * (1 + (0.35 * np.sin(t * 0.8) if s else 0.0)) + rng.normal(0, 0.15, (4, 2))
        if t % 60 == 30:
            shape[1] += (30, -30)
        rot = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        rows.append(("m", t, [[float(q) for q in w] for w in shape @ rot.T + c], [0.05 if t % 60 == 30 and k == 1 else 1.0 for k in range(4)]))
    f = frames(spark, rows)
    cleaned = formatting.aligned(formatting.cleaned(f, [0, 1, 2, 3]), [3], [0])
    pca = formatting.pca_fit(cleaned, "v", 8)
    segments = formatting.format_data(f, [0, 1, 2, 3], 150, lags=2, noise=0.05)
    p, state = P.start(segments, 4, [3], [0], pca, model.Hyper(states=5, lags=2, kappa=50.0), 2, seed=1)
    assert sorted((r.seg, r.skip, len(r.frames)) for r in state.collect()) == [(0, 0, 150), (1, 2, 152), (2, 2, 62)]
    fitted, state = P.fit(p, state, iterations=12, seed=1)
    assert len(fitted.trace) == 12 and fitted.trace[-1] > fitted.trace[0] and fitted.ar.betas.sum() == pytest.approx(1)
    res = P.extract(fitted, P.apply(fitted, state, 2, seed=2)).orderBy("frame").collect()
    assert [r.frame for r in res] == list(range(360)) and len(res[0].latent_state) == 2
    z, tr = np.array([r.syllable for r in res]), np.array(truth)
    agree = sum(max(np.bincount(tr[z == k], minlength=2)) for k in np.unique(z)) / len(z)
    assert agree > 0.8
    v = np.array([r.centroid for r in res])
    obs = np.median(np.array([q[2] for q in rows]), 1)
    assert np.median(np.abs(v - obs)) < 2.0
    # the outlier keypoint does not pull its centroid along
    hit = np.arange(360) % 60 == 30
    assert np.abs(v - obs)[hit].max() < 15


def test_segments_of_any_lengths_are_drawn_together():
    """Joined end to end, segments of different lengths have the moments of each alone, and a pass costs no loop per segment."""
    rng = np.random.default_rng(8)
    p, (y, v, ang, s, z), _ = toy(rng, t=9, b=1)
    cut, many = [9, 4, 6], 5000
    rows = np.tile(np.concatenate([np.arange(n) for n in cut]), many)
    size, full = np.tile(cut, many), np.r_[0, 0, z][rows]
    joined = P._latents(p, y[rows], v[rows], ang[rows], s[rows], full, size, np.random.default_rng(9)).reshape(many, sum(cut), 2)
    walk = P._centroids(p, y[rows], np.zeros((len(rows), 2)), ang[rows], s[rows], size, np.random.default_rng(10)).reshape(many, sum(cut), 2)
    for n, to in zip(cut, np.cumsum(cut)):
        own = [np.tile(a[:n], (many, *([1] * a.ndim))) for a in (y, v, ang, s)]
        alone = P.draw_latents(p, *own, np.tile(z[: n - 2], (many, 1)), np.random.default_rng(11))
        assert np.abs(alone.mean(0) - joined[:, to - n : to].mean(0)).max() < 0.12 and np.abs(alone.std(0) - joined[:, to - n : to].std(0)).max() < 0.12
        alone = P.draw_centroids(p, own[0], np.zeros((many, n, 2)), own[2], own[3], np.random.default_rng(12))
        assert np.abs(alone.mean(0) - walk[:, to - n : to].mean(0)).max() < 0.05 and np.abs(alone.std(0) - walk[:, to - n : to].std(0)).max() < 0.05
    assert np.abs(np.corrcoef(joined[:, 8, 0], joined[:, 9, 0])[0, 1]) < 0.06  # nothing passes from one segment to the next


def test_a_pass_joins_segments_and_returns_its_sums(spark):
    rng = np.random.default_rng(13)
    p, (y, v, ang, s, _), _ = toy(rng, t=30, b=1)
    row = lambda rec, n: (rec, 0, 0, list(range(n)), *(bytearray(P._pack(a[:n])) for a in (y, s, np.zeros((30, 2)), v, ang, s)), bytearray(P._pack(np.zeros(n - 2, np.int64))), None)
    state = spark.createDataFrame([row("a", 30), row("b", 11), row("c", 20)], P.ROW).coalesce(1)
    new = P.iterate(p, state, 1, 0)
    got = {r.recording: r for r in new.collect()}
    assert {k: len(np.frombuffer(bytes(r.x))) // 2 for k, r in got.items()} == {"a": 30, "b": 11, "c": 20}
    assert sum(r.sums is not None for r in got.values()) == 1
    total, x, z = P.statistics(new), [np.frombuffer(bytes(got[k].x)).reshape(-1, 2) for k in "acb"], [np.frombuffer(bytes(got[k].z), np.int64) for k in "acb"]
    trans = np.zeros((2, 2))
    for q in z:
        np.add.at(trans, (q[:-1], q[1:]), 1)
    assert np.array_equal(total[:4].reshape(2, 2), trans) and total[-2] == 61
    now = np.concatenate([a[2:] for a in x])[np.concatenate(z) == 0]
    assert np.allclose(total[4 + 25 + 10 : 4 + 25 + 10 + 4].reshape(2, 2), now.T @ now)
