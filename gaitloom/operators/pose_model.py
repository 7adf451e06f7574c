"""The whole model: poses seen through noise, from latent trajectories with autoregressive states.

A frame's keypoints are the loadings of a latent state, turned by the heading and moved to the
centroid, with noise per keypoint and frame. Gibbs sampling draws, in turn: behaviour states (as the
model of latents does), latent trajectories (Kalman filter forwards, sampling backwards), centroids
(a random walk), headings, noise scales, and, from sums over all segments, the parameters.

Plan. A segment is one row with its arrays, a few megabytes at most. An iteration is one narrow pass
over the segments, written once, with the sums that the parameters come from. A task joins segments of any
lengths end to end; trajectories are drawn from their precision by cyclic reduction, without a loop over time.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitloom.operators import model as M
from gaitloom.operators.formatting import Pca
from gaitloom.session import durable, release, spread

#: Degrees of freedom and scale of the noise priors, variance of the centroid's steps, prior variance of a first latent state.
NU_S, NU_SIGMA, SIGMASQ_0, FIRST = 5.0, 1e5, 0.1, 10.0
#: Rows that are drawn at once, if a segment has no more.
HELD = 40_000
ROW = "recording string, seg bigint, skip int, frames array<int>, y binary, s0 binary, x binary, v binary, h binary, s binary, z binary, sums binary"


@dataclass
class PoseParams:
    ar: M.Params
    loadings: np.ndarray  # (2 * keypoints, dims + 1), the last column the mean pose
    sigmasq: np.ndarray  # per keypoint
    sigmasq_loc: float = 0.5
    trace: list[float] = field(default_factory=list)


def noise_prior(conf: np.ndarray, slope: float = -0.5, intercept: float = 0.25) -> np.ndarray:
    """Prior noise scale of a keypoint from its confidence: the squared error that the calibration expects."""
    return 10.0 ** (2 * (slope * np.log10(conf) + intercept))


def _plane(points: np.ndarray) -> np.ndarray:
    """Points (..., 2) as complex numbers, so that turning is a product."""
    return np.ascontiguousarray(points, float).view(complex)[..., 0]


def _turn(points: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Points (..., k, 2) turned by the angles h (...)."""
    return (_plane(points) * np.exp(1j * h)[..., None])[..., None].view(float)


def shapes(p: PoseParams, x: np.ndarray) -> np.ndarray:
    """Poses (..., k, 2), centred and unturned, of latent states (..., dims)."""
    y = x @ p.loadings[:, :-1].T + p.loadings[:, -1]
    return y.reshape(*x.shape[:-1], -1, 2)


def draw_chain(d: np.ndarray, e: np.ndarray, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw (n, m, r) from the Gaussian of n blocks whose precision has the blocks d (n, m, m) and, between each and the next, e (n - 1, m, m).

    ``h`` (n, m, r) are the linear terms; columns are independent. Cyclic reduction: every second block
    depends on its two neighbours alone, and without it these are such a chain again.
    """
    odd, even = h[1::2], h[::2].copy()
    root = np.linalg.inv(np.linalg.cholesky(d[1::2] if len(h) > 1 else d))
    if len(h) == 1:
        return root.transpose(0, 2, 1) @ (root @ h + rng.standard_normal(h.shape))
    a, b = root @ e[::2].transpose(0, 2, 1), root[: len(even) - 1] @ e[1::2]
    at, bt, g = a.transpose(0, 2, 1), b.transpose(0, 2, 1), root @ odd
    rest, k = d[::2].copy(), len(b)
    rest[: len(a)] -= at @ a
    rest[1:] -= bt @ b
    even[: len(a)] -= at @ g
    even[1:] -= bt @ g[:k]
    x = np.empty_like(h)
    x[::2] = near = draw_chain(rest, -at[:k] @ b, even, rng)
    g = g - a @ near[: len(a)] + rng.standard_normal(odd.shape)
    g[:k] -= b @ near[1:]
    x[1::2] = root.transpose(0, 2, 1) @ g
    return x


def draw_line(d: np.ndarray, e: np.ndarray, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """:func:`draw_chain` with blocks of one: d (n), e (n - 1), h (n, r)."""
    root = 1 / np.sqrt(d[1::2] if len(h) > 1 else d)
    if len(h) == 1:
        return root[:, None] * (root[:, None] * h + rng.standard_normal(h.shape))
    odd, even, k = h[1::2], h[::2].copy(), (len(h) - 1) // 2
    a, b, g = root * e[::2], root[:k] * e[1::2], root[:, None] * odd
    rest = d[::2].copy()
    rest[: len(a)] -= a * a
    rest[1:] -= b * b
    even[: len(a)] -= a[:, None] * g
    even[1:] -= b[:, None] * g[:k]
    x = np.empty_like(h)
    x[::2] = near = draw_line(rest, -a[:k] * b, even, rng)
    g += rng.standard_normal(odd.shape) - a[:, None] * near[: len(a)]
    g[:k] -= b[:, None] * near[1:]
    x[1::2] = root[:, None] * g
    return x


def _latents(p: PoseParams, y: np.ndarray, v: np.ndarray, h: np.ndarray, s: np.ndarray, z: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Latent trajectories (rows, d) of segments with ``size`` rows, joined end to end; ``z`` has a state for every row, the first ``lags`` of a segment unread.

    Information filter: a step takes the oldest of the last ``lags`` + 1 rows out of their precision, for
    all segments that are that long at once (last axis); draws go backwards. Long segments, where few
    share a step, are drawn by :func:`draw_chain` in blocks of ``lags`` rows.
    """
    lags, c, d, k = p.ar.hyper.lags, p.loadings[:, :-1], p.loadings.shape[1] - 1, s.shape[1]
    seen, w = _turn(y - v[:, None], -h).reshape(len(y), 2 * k) - p.loadings[:, -1], 1 / (s * p.sigmasq)
    pairs = (c[:, :, None] * c[:, None]).reshape(k, 2, d * d).sum(1)
    step = np.concatenate([-p.ar.ab[:, :, :-1], np.tile(np.eye(d), (len(p.ar.ab), 1, 1))], 2)
    back = step.transpose(0, 2, 1) @ np.linalg.inv(p.ar.q)
    quad = np.concatenate([back @ step, back @ p.ar.ab[:, :, -1:]], 2)  # the last column: linear terms
    own, lin = w @ pairs, (np.repeat(w, 2, 1) * seen) @ c
    if len(y) < 24 * size.max():
        return _latents_chain(quad, own.reshape(-1, d, d), lin, z, size, lags, rng)
    order, live, base, rows = M.side_by_side(size)
    own, lin, z = np.ascontiguousarray(own[rows].T).reshape(d, d, -1), np.ascontiguousarray(lin[rows].T), z[rows]
    quad, ld, n = np.ascontiguousarray(quad.transpose(1, 2, 0)), lags * d, len(size)
    held, kept = np.zeros((ld, ld + 1, n)), np.empty((d, ld + d + 1, len(y)))
    for r in range(lags):
        a = slice(r * d, r * d + d)
        held[a, a] = own[:, :, r * n : r * n + n] + np.eye(d)[:, :, None] / FIRST
        held[a, ld] = lin[:, r * n : r * n + n]
    for t in range(lags, len(live)):
        m, o = live[t], slice(base[t], base[t] + live[t])
        f = quad.take(z[o], 2)
        f[:ld, :ld] += held[:, :ld, :m]
        f[:ld, -1] += held[:, ld, :m]
        f[ld:, ld:-1] += own[:, :, o]
        f[ld:, -1] += lin[:, o]
        for i in range(d):
            f[i, i:] /= np.sqrt(f[i, i])
            for j in range(i + 1, d):
                f[j, j:] -= f[i, j] * f[i, j:]
        top = f[:d, d:]
        for a in range(0, ld, d):  # what lies left of a block on the diagonal is never read
            for i in range(d):
                f[d + a : 2 * d + a, d + a :] -= top[i, a : a + d, None] * top[i, a:]
        held[:, :, :m], kept[:, :, o] = f[d:, d:], f[:d]
    root = held[:, :ld].transpose(2, 1, 0)  # its lower blocks are the ones that hold
    root = np.linalg.inv(np.linalg.cholesky(root))
    last = root.transpose(0, 2, 1) @ (root @ held[:, ld].T[..., None] + rng.standard_normal((n, ld, 1)))
    near, x = np.ascontiguousarray(last[..., 0].T), np.empty((d, len(y)))
    kept[:, -1] += rng.standard_normal((d, len(y)))
    for t in range(len(live) - 1, lags - 1, -1):
        m, o = live[t], slice(base[t], base[t] + live[t])
        f = kept[:, :, o]
        g = f[:, -1] - (f[:, d:-1] * near[:, :m]).sum(1)
        for i in range(d - 1, -1, -1):
            g[i] /= f[i, i]
            g[:i] -= f[:i, i] * g[i]
        near[d:, :m] = near[:-d, :m].copy()
        near[:d, :m] = x[:, base[t - lags] : base[t - lags] + m] = g
    out = np.empty((len(y), d))
    out[rows] = x.T
    ends = np.cumsum(size)[order]
    for r in range(lags):
        out[ends - lags + r] = last[:, r * d : r * d + d, 0]
    return out


def _latents_chain(quad: np.ndarray, own: np.ndarray, lin: np.ndarray, z: np.ndarray, size: np.ndarray, lags: int, rng: np.random.Generator) -> np.ndarray:
    """The draws of :func:`_latents` without a loop over time; blocks of ``lags`` rows, so that a row reaches back to the block before at most."""
    d, total = lin.shape[1], len(lin)
    blocks = -(-size // lags)
    n, ld, t = int(blocks.sum()), lags * d, np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    place = t + np.repeat((np.cumsum(blocks) - blocks) * lags, size)
    diag, linear = np.tile(np.eye(d), (n * lags, 1, 1)), np.zeros((n * lags, d))  # places behind a segment's end stand alone
    diag[place], linear[place] = own, lin
    diag[place[t < lags]] += np.eye(d) / FIRST
    both, shift = np.zeros((n, 2 * ld, 2 * ld)), np.zeros((n, 2 * ld))
    for r in range(lags):
        rows = (t >= lags) & (t % lags == r)
        i, a = place[rows] // lags, slice(r * d, r * d + ld + d)
        both[i, a, a] += quad[z[rows], :, :-1]
        shift[i, a] += quad[z[rows], :, -1]
        a = slice(ld + r * d, ld + r * d + d)
        both[:, a, a] += diag[r::lags]
    both[:-1, ld:, ld:] += both[1:, :ld, :ld]
    linear = linear.reshape(n, ld) + shift[:, ld:]
    linear[:-1] += shift[1:, :ld]
    return draw_chain(both[:, ld:, ld:], both[1:, :ld, ld:], linear[..., None], rng).reshape(n * lags, d)[place]


def _joined(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, *a.shape[2:])


def draw_latents(p: PoseParams, y: np.ndarray, v: np.ndarray, h: np.ndarray, s: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Latent trajectories (b, t, d) of equally long segments given everything else."""
    b, t = s.shape[:2]
    z = np.concatenate([np.zeros((b, p.ar.hyper.lags), np.int64), z], 1)
    return _latents(p, *map(_joined, (y, v, h, s, z)), np.full(b, t), rng).reshape(b, t, -1)


def _centroids(p: PoseParams, y: np.ndarray, x: np.ndarray, h: np.ndarray, s: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centroids (rows, 2) of segments with ``size`` rows, joined end to end: a random walk seen through every keypoint."""
    w = 1 / (s * p.sigmasq)
    lin = np.einsum("nk,nk->n", w, _plane(y) - _plane(shapes(p, x)) * np.exp(1j * h)[:, None])[:, None].view(float)
    link = np.ones(len(y) + 1)  # between a row and the one before
    link[np.r_[0, np.cumsum(size)]] = 0
    link /= p.sigmasq_loc
    prec = w.sum(1) + link[:-1] + link[1:]
    return draw_line(prec, -link[1:-1], lin, rng)


def draw_centroids(p: PoseParams, y: np.ndarray, x: np.ndarray, h: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centroids (b, t, 2) of equally long segments."""
    b, t = s.shape[:2]
    return _centroids(p, *map(_joined, (y, x, h, s)), np.full(b, t), rng).reshape(b, t, 2)


def draw_headings(p: PoseParams, y: np.ndarray, x: np.ndarray, v: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Headings (b, t), von Mises given the rest."""
    a, o, w = _plane(shapes(p, x)), _plane(y) - _plane(v)[..., None], 1 / (s * p.sigmasq)
    q = np.einsum("...k,...k->...", w * a.conj(), o)
    return rng.vonmises(np.angle(q), np.minimum(np.abs(q), 1e8))


def residuals(p: PoseParams, y: np.ndarray, x: np.ndarray, v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Squared distances (b, t, k) of the keypoints from where the model puts them."""
    r = _plane(y) - _plane(v)[..., None] - _plane(shapes(p, x)) * np.exp(1j * h)[..., None]
    return r.real**2 + r.imag**2


def draw_scales(r: np.ndarray, sigmasq: np.ndarray, s0: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return (NU_S * s0 + r / sigmasq) / rng.chisquare(NU_S + 2, r.shape)


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def first(p: PoseParams, y: np.ndarray, anterior: list[int], posterior: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent states, centroids and headings that sampling starts from."""
    v = np.median(y, 1)
    d = y[:, anterior].mean(1) - y[:, posterior].mean(1)
    h = np.arctan2(d[:, 1], d[:, 0])
    return (_turn(y - v[:, None], -h).reshape(len(y), -1) - p.loadings[:, -1]) @ p.loadings[:, :-1], v, h


def start(segments: DataFrame, keypoints: int, anterior: list[int], posterior: list[int], pca: Pca, hyper: M.Hyper, dims: int, seed: int = 0, slope: float = -0.5, intercept: float = 0.25) -> tuple[PoseParams, DataFrame]:
    """First parameters and one row per segment (schema ``ROW``) from :func:`formatting.format_data`.

    Centroids are medians, headings run from the back to the front of the body, latent states are
    scores of the aligned poses. Segments with no more rows than lags + 1 are left out.
    """
    p = PoseParams(M.initial(hyper, dims, seed), np.c_[pca.components[:dims].T, pca.mean], np.full(keypoints, SIGMASQ_0))

    def make(g: pd.DataFrame) -> dict:
        g = g.sort_values("pos")
        y = np.stack([np.array(g["x"].tolist(), float), np.array(g["y"].tolist(), float)], -1)
        x, v, h = first(p, y, anterior, posterior)
        s0 = noise_prior(np.array(g["conf"].tolist(), float), slope, intercept)
        return {"skip": int(g["context"].sum()), "frames": g["frame"].to_numpy(np.int32), "y": _pack(y), "s0": _pack(s0), "x": _pack(x), "v": _pack(v), "h": _pack(h), "s": _pack(s0), "z": _pack(np.zeros(len(g) - hyper.lags, np.int64)), "sums": None}

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"recording": key[0], "seg": key[1], **make(g)}] if len(g) > hyper.lags + 1 else [], columns=[c.split()[0] for c in ROW.split(", ")])

    return p, durable(spread(segments, "recording", "seg").groupBy("recording", "seg").applyInPandas(run, ROW))


def run_pass(p: PoseParams, y: np.ndarray, s0: np.ndarray, x: np.ndarray, v: np.ndarray, h: np.ndarray, size: np.ndarray, rng: np.random.Generator, s: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """One Gibbs pass over segments with ``size`` rows, joined end to end: (x, v, h, s, z) and their sums.

    Noise scales ``s`` are drawn last. Where they were not kept, they are drawn first, from where the
    last pass left the rest, and stay. The sums are those of the autoregression, noise per keypoint,
    rows, log density of the observations.
    """
    lags, kept = p.ar.hyper.lags, s is not None
    if not kept:
        s = draw_scales(residuals(p, y[None], x[None], v[None], h[None])[0], p.sigmasq, s0, rng)
    z = M.draw_joined(p.ar, x, size, rng)
    later = np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size) >= lags
    full = np.zeros(len(y), np.int64)
    full[later] = z
    x = _latents(p, y, v, h, s, full, size, rng)
    v = _centroids(p, y, x, h, s, size, rng)
    h = draw_headings(p, y[None], x[None], v[None], s[None], rng)[0]
    r = residuals(p, y[None], x[None], v[None], h[None])[0]
    if kept:
        s = draw_scales(r, p.sigmasq, s0, rng)
    var, ahead = s * p.sigmasq, np.cumsum(size - lags)
    total = M.joined_sums(M.designs(x, size, lags), x.shape[1], z, np.r_[0, ahead[:-1]], p.ar.hyper.states)
    return (x, v, h, s, z), np.r_[total, (r / s).sum(0), len(r), -(r / var / 2 + np.log(2 * np.pi * var)).sum()]


def sweep(p: PoseParams, rows: list[dict], rng: np.random.Generator) -> np.ndarray:
    """:func:`run_pass` over segments in rows, whose arrays are replaced in place; returns the sums."""
    k, d, lags = len(p.sigmasq), p.loadings.shape[1] - 1, p.ar.hyper.lags
    get = lambda c, *shape: np.concatenate([np.frombuffer(r[c]) for r in rows]).reshape(-1, *shape)
    size = np.array([len(r["frames"]) for r in rows])
    cuts, ahead = np.cumsum(size)[:-1], np.cumsum(size - lags)[:-1]
    drawn, total = run_pass(p, get("y", k, 2), get("s0", k), get("x", d), get("v", 2), get("h"), size, rng, get("s", k))
    parts = [np.split(a, at) for a, at in zip(drawn, [cuts] * 4 + [ahead])]
    for row, *own in zip(rows, *parts):
        row |= dict(zip("xvhsz", map(_pack, own)))
    return total


def _batches(rows: list[dict]):
    """The segments, longest first, in lists of about ``HELD`` rows."""
    some, held = [], 0
    for r in sorted(rows, key=lambda r: (-len(r["frames"]), r["recording"], r["seg"])):
        if some and held + len(r["frames"]) > HELD:
            yield some
            some, held = [], 0
        some.append(r)
        held += len(r["frames"])
    if some:
        yield some


def iterate(p: PoseParams, state: DataFrame, seed: int, it: int) -> DataFrame:
    """The segments after one pass under the parameters ``p``, written once; one row of a batch has its sums."""

    def work(batches):
        for b in batches:
            rows = b.to_dict("records")
            for row in rows:
                row["sums"] = None
            total = 0
            for some in _batches(rows):
                first = some[0]
                total = total + sweep(p, some, np.random.default_rng([seed, it, len(some), int(first["seg"]), *first["recording"].encode()[-8:]]))
            if rows:
                rows[0]["sums"] = _pack(total)
            yield pd.DataFrame(rows, columns=list(b.columns))

    return durable(state.mapInPandas(work, ROW))


def statistics(state: DataFrame) -> np.ndarray:
    """The sums of :func:`sweep` over all segments; at most 8 rows reach the driver."""

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [g["k"].min()], "s": [sum(np.frombuffer(bytes(v)) for v in g.sort_values(["k", "recording", "seg"])["s"]).tobytes()]})

    some = state.where("sums is not null").select(F.spark_partition_id().alias("k"), "recording", "seg", F.col("sums").alias("s"))
    parts = some.groupBy(F.pmod("k", F.lit(8))).applyInPandas(add, "k int, s binary").collect()
    return sum(np.frombuffer(bytes(r.s)) for r in sorted(parts, key=lambda r: r.k))


def next_params(p: PoseParams, sums: np.ndarray, seed: int, it: int) -> PoseParams | None:
    """Parameters drawn from the sums of iteration ``it``; none, with a warning, if a value is not finite."""
    d, k, rng = p.loadings.shape[1] - 1, len(p.sigmasq), np.random.default_rng([seed, it])
    try:
        if not np.isfinite(sums).all():
            raise FloatingPointError("a sum is not finite")
        ar = M.draw_params(p.ar.hyper, sums[: -k - 2], d, rng, p.ar.betas)
    except (FloatingPointError, np.linalg.LinAlgError) as e:
        warnings.warn(f"iteration {it}: {e}; the fit stops here", stacklevel=3)
        return None
    sigmasq = (NU_SIGMA * SIGMASQ_0 + sums[-k - 2 : -2]) / rng.chisquare(NU_SIGMA + 2 * sums[-2], k)
    return PoseParams(ar, p.loadings, sigmasq, p.sigmasq_loc, [*p.trace, float(sums[-1])])


def fit(p: PoseParams, state: DataFrame, iterations: int = 50, seed: int = 0) -> tuple[PoseParams, DataFrame]:
    """Gibbs sampling of everything: the last parameters, with the trace of log densities, and the segments.

    A value that is not finite ends the sampling with a warning; the parameters before it are returned.
    Segments may be those of :func:`pose_store.build`; the folder of the last draws is returned for them.
    """
    if not isinstance(state, DataFrame):
        return state.sample(p, iterations, seed)
    given = state
    if state.isEmpty():
        return p, state
    for it in range(iterations):
        new = iterate(p, state, seed, it)
        sums = statistics(new)
        after = next_params(p, sums, seed, it)
        if after is None:
            return p, state
        if state is not given:
            release(state)
        p, state = after, new
    return p, state


def apply(p: PoseParams, state: DataFrame, iterations: int = 10, seed: int = 0) -> DataFrame:
    """The segments after ``iterations`` passes under fixed parameters."""
    given = state
    for it in range(iterations):
        state, old = iterate(p, state, seed, it), state
        if old is not given:
            release(old)
    return state


def extract(p: PoseParams, state: DataFrame) -> DataFrame:
    """Results per frame: recording, frame, syllable, latent_state, centroid, heading; context rows left out.

    The first ``lags`` rows of a recording repeat its first state.
    """
    d, lags = p.loadings.shape[1] - 1, p.ar.hyper.lags

    def work(batches):
        for b in batches:
            for r in b.to_dict("records"):
                z = np.frombuffer(r["z"], np.int64)
                z, x, v, h = np.r_[np.repeat(z[:1], lags), z], np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["v"]).reshape(-1, 2), np.frombuffer(r["h"])
                own = slice(r["skip"], None)
                yield pd.DataFrame({"recording": r["recording"], "frame": np.asarray(r["frames"])[own], "syllable": z[own].astype(np.int32), "latent_state": list(x[own]), "centroid": list(v[own]), "heading": h[own]})

    return state.mapInPandas(work, "recording string, frame int, syllable int, latent_state array<double>, centroid array<double>, heading double")
