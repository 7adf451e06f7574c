"""Segmentation models: batching, PCA, autoregressive HMM by Gibbs sampling, application, marginals, comparison.

Generative model (published): sticky transitions pi_i ~ Dir(alpha / N + kappa [i = j]), latent
x_t = A_z [x_{t-lags} .. x_{t-1}, 1] + N(0, Q_z) with a matrix-normal-inverse-Wishart prior. Segments
are independent tasks; only sufficient statistics (states x states and states x dims x dims) are
added up and reach the driver, whose new parameters go out with the next pass.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.session import durable, spread


def segment_length(lengths: list[int], most: int = 10_000, padding: float = 50.0, least: int = 4) -> int:
    """Longest common segment length whose padding stays within ``padding`` per cent and whose rests are at least ``least``."""
    total = sum(lengths)
    pad = lambda s: sum(-n % s for n in lengths) / total * 100
    tries = sorted({min(n, most) for n in lengths}, reverse=True)
    size = next((s for s in tries if pad(s) <= padding), most)
    while True:
        rests = [n % size for n in lengths if n % size]
        if all(r >= least for r in rests):
            return size
        size += min(rests)


def padding_share(rows: DataFrame, size: int) -> DataFrame:
    """One row: per cent of padding that segments of ``size`` need."""
    per = rows.groupBy("recording").agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.pmod(-F.col("n"), F.lit(size))) / F.sum("n") * 100).alias("padding"))


def segments(rows: DataFrame, size: int) -> DataFrame:
    """recording, seg, start, end (positions, half open) of every segment."""
    return rows.groupBy("recording", F.floor(F.col("pos") / size).alias("seg")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def variance_explained(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """Cumulative share of variance by component: component, share, cumulative. See :func:`formatting.pca_fit`."""
    from gaitloom.operators.formatting import pca_fit

    share = pca_fit(vectors, column, dims).shares()
    rows = [(k, float(s), float(c)) for k, (s, c) in enumerate(zip(share, np.cumsum(share)))]
    return vectors.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def dims_to_explain(variance: DataFrame, share: float) -> DataFrame:
    """One row: the fewest components whose cumulative share exceeds ``share``."""
    return variance.where(F.col("cumulative") > share).agg((F.min("component") + 1).alias("dims"))


@dataclass
class Hyper:
    """Priors; scalar fields may be replaced by :func:`update`."""

    states: int = 10
    lags: int = 2
    alpha: float = 5.7
    kappa: float = 100.0
    gamma: float = 1000.0
    s0: float = 0.01
    k0: float = 10.0


def update(h: Hyper, **values) -> Hyper:
    """New priors with the given scalars, cast to the old type; unknown names are refused."""
    for k in values:
        if not hasattr(h, k):
            raise ValueError(f"unknown hyper-parameter {k}")
    return replace(h, **{k: type(getattr(h, k))(v) for k, v in values.items()})


@dataclass
class Params:
    pi: np.ndarray
    ab: np.ndarray
    q: np.ndarray
    hyper: Hyper = field(default_factory=Hyper)
    betas: np.ndarray | None = None  # shares of the states over all rows; equal ones where None


def initial(hyper: Hyper, dims: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    n, d = hyper.states, dims
    ab = np.zeros((n, d, d * hyper.lags + 1))
    for k in range(n):
        ab[k, :, d * (hyper.lags - 1) : d * hyper.lags] = np.eye(d) + 0.1 * rng.standard_normal((d, d))
        ab[k, :, -1] = 0.1 * rng.standard_normal(d)
    pi = np.full((n, n), 1.0) + hyper.kappa * np.eye(n)
    return Params(pi / pi.sum(1, keepdims=True), ab, np.tile(np.eye(d) * 0.5, (n, 1, 1)), hyper)


def _design(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    t = len(x)
    past = np.concatenate([x[i : t - lags + i] for i in range(lags)] + [np.ones((t - lags, 1))], 1)
    return past, x[lags:]


def log_likelihoods(p: Params, x: np.ndarray) -> np.ndarray:
    past, now = _design(x, p.hyper.lags)
    out = np.empty((len(now), p.hyper.states))
    for k in range(p.hyper.states):
        c = np.linalg.cholesky(p.q[k])
        r = np.linalg.solve(c, (now - past @ p.ab[k].T).T)
        out[:, k] = -0.5 * (r**2).sum(0) - np.log(np.diag(c)).sum() - 0.5 * now.shape[1] * np.log(2 * np.pi)
    return out


def forward(p: Params, ll: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered state probabilities and the log likelihood."""
    a = np.empty_like(ll)
    total, prev = 0.0, np.full(p.hyper.states, 1 / p.hyper.states)
    for t in range(len(ll)):
        m = ll[t].max()
        v = (prev if t == 0 else prev @ p.pi) * np.exp(ll[t] - m)
        s = v.sum()
        total += float(np.log(s) + m)
        prev = a[t] = v / s
    return a, total


def sample_states(p: Params, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw of the states of a segment, by forward filtering and backward sampling."""
    a, _ = forward(p, log_likelihoods(p, x))
    z = np.empty(len(a), np.int64)
    u = rng.random(len(a))
    for t in range(len(a) - 1, -1, -1):
        w = a[t] if t == len(a) - 1 else a[t] * p.pi[:, z[t + 1]]
        z[t] = min(np.searchsorted(np.cumsum(w), u[t] * w.sum()), p.hyper.states - 1)
    return z


def marginals(p: Params, x: np.ndarray) -> np.ndarray:
    """Posterior state probabilities of a segment."""
    ll = log_likelihoods(p, x)
    a, _ = forward(p, ll)
    b = np.ones(p.hyper.states)
    out = a.copy()
    for t in range(len(a) - 2, -1, -1):
        b = p.pi @ (np.exp(ll[t + 1] - ll[t + 1].max()) * b)
        b /= b.sum()
        out[t] = a[t] * b
        out[t] /= out[t].sum()
    return out


def draw_states(p: Params, xs: list[np.ndarray], draws: list[np.random.Generator]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """One draw of the states of several segments: (order of the segments, past, now, states, first rows, log likelihood).

    Segments come one after another, long ones first. Step t is one matrix product over all segments
    that are that long; the draws are those of :func:`sample_states`.
    """
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    parts = [_design(xs[i], p.hyper.lags) for i in order]
    past, now = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    n, d, size = p.hyper.states, now.shape[1], np.array([len(b) for _, b in parts])
    at, u = np.r_[0, np.cumsum(size)[:-1]], np.concatenate([draws[i].random(k) for i, k in zip(order, size)])
    c = np.linalg.inv(np.linalg.cholesky(p.q))
    w = np.concatenate([-c @ p.ab, c], 2)  # whitened residuals as one product
    both = np.concatenate([past, now], 1)
    ll = -0.5 * sum((both @ w[:, j].T) ** 2 for j in range(d)) + np.log(np.diagonal(c, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi)
    m = ll.max(1)
    a, total = np.exp(ll - m[:, None]), m.sum()
    live = [int((size > t).sum()) for t in range(size[0])]
    prev = np.full((len(size), n), 1 / n)
    for t, k in enumerate(live):
        v = (prev[:k] if t == 0 else prev[:k] @ p.pi) * a[at[:k] + t]
        s = v.sum(1, keepdims=True)
        total += np.log(s).sum()
        prev = a[at[:k] + t] = v / s
    z, to = np.empty(len(now), np.int64), np.ascontiguousarray(p.pi.T)
    for t in range(size[0] - 1, -1, -1):
        k, on = live[t], live[t + 1] if t + 1 < size[0] else 0
        v = a[at[:k] + t]
        v[:on] *= to[z[at[:on] + t + 1]]
        v = np.cumsum(v, 1)
        z[at[:k] + t] = np.minimum((v < (u[at[:k] + t] * v[:, -1])[:, None]).sum(1), n - 1)
    return order, past, now, z, at, total


def side_by_side(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments with ``size`` rows, joined end to end, by step instead: (order of the segments, long ones first; how many have a step; first place of each step; row at every place)."""
    order = np.argsort(-size, kind="stable")
    start, long = (np.cumsum(size) - size)[order], size[order]
    live = np.searchsorted(-long, -np.arange(long[0]), "left")
    base = np.cumsum(live) - live
    rows = start[np.arange(live.sum()) - np.repeat(base, live)] + np.repeat(np.arange(len(live)), live)
    return order, live, base, rows


def designs(x: np.ndarray, size: np.ndarray, lags: int) -> np.ndarray:
    """The ``lags`` rows before a row, a one and the row itself, of segments joined end to end; a segment's first ``lags`` rows are left out."""
    t = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(t >= lags)
    return np.concatenate([x[at - lags + i] for i in range(lags)] + [np.ones((len(at), 1)), x[at]], 1)


def draw_joined(p: Params, x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw of the states of segments with ``size`` rows, joined end to end, without the first ``lags`` of each.

    Rows stand by step, so that a step is one product of neighbouring rows. Probabilities are held in
    single precision, the least ones as 0; if a step's sum comes near them, all are drawn in double precision.
    """
    n, d, ahead = p.hyper.states, x.shape[1], size - p.hyper.lags
    _, live, base, rows = side_by_side(ahead)
    both, u = designs(x, size, p.hyper.lags)[rows], rng.random(len(rows))[rows]
    c = np.linalg.inv(np.linalg.cholesky(p.q))
    w = np.concatenate([-c @ p.ab, c], 2).transpose(1, 2, 0) * np.sqrt(0.5)  # whitened residuals: (d, features, states)
    level = np.log(np.diagonal(c, axis1=1, axis2=2)).sum(1)
    for kind, least in ((np.float32, 1e-30), (np.float64, 0)):
        a, pi, one = np.empty((len(rows), n), kind), np.where(p.pi > least * 1e-6, p.pi, 0).astype(kind), np.ones((n, 1), kind)
        for i in range(0, len(rows), 512):
            part, ll = both[i : i + 512], level
            for j in range(d):
                r = part @ w[j]
                r *= r
                ll = np.subtract(ll, r, out=r)
            ll -= ll.max(1, keepdims=True)
            e = np.exp(ll.astype(kind, copy=False))
            a[i : i + 512] = np.where(e > least * 1e-6, e, 0) if least else e  # numbers too small for their kind are slow
        norm, prev = np.empty((len(rows), 1), kind), np.full((len(size), n), 1 / n, kind)
        for o, k in zip(base, live):
            v = a[o : o + k]
            v *= prev[:k] @ pi if o else prev
            v /= np.matmul(v, one, out=norm[o : o + k])
            prev = v
        if norm.min() > least:
            break
    u = u.astype(kind)
    z, to, on = np.empty(len(rows), np.int64), np.ascontiguousarray(pi.T), 0
    for o, k in zip(base[::-1], live[::-1]):
        v = a[o : o + k]
        if on:
            v[:on] *= to[near]
        v = v.cumsum(1)
        near = z[o : o + k] = (v[:, :-1] < (u[o : o + k, None] * v[:, -1:])).sum(1)
        on = k
    out = np.empty_like(z)
    out[rows] = z
    return out


def joined_sums(both: np.ndarray, dims: int, z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """:func:`sums` from :func:`designs` of ``dims`` columns; rows are sorted by state once."""
    step = np.ones(len(z), bool)
    step[at] = False
    trans = np.bincount(z[:-1][step[1:]] * n + z[1:][step[1:]], minlength=n * n)
    own, ends = both[np.argsort(z, kind="stable")], np.r_[0, np.cumsum(np.bincount(z, minlength=n))]
    out, f = [trans], both.shape[1] - dims
    for i, j in zip(ends[:-1], ends[1:]):
        g = own[i:j].T @ own[i:j]
        out += [g[:f, :f].ravel(), g[f:, :f].ravel(), g[f:, f:].ravel(), [j - i]]
    return np.concatenate(out)


def sums(past: np.ndarray, now: np.ndarray, z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sufficient statistics of segments with first rows ``at``, laid out as :func:`draw_params` reads them."""
    trans, step = np.zeros((n, n)), np.ones(len(z), bool)
    step[at] = False
    np.add.at(trans, (z[:-1][step[1:]], z[1:][step[1:]]), 1)
    out = [trans.ravel()]
    for k in range(n):
        f, g = past[z == k], now[z == k]
        out += [(f.T @ f).ravel(), (g.T @ f).ravel(), (g.T @ g).ravel(), [len(g)]]
    return np.concatenate(out)


def _sweep(p: Params, xs: list[np.ndarray], draws: list[np.random.Generator]) -> np.ndarray:
    """Sufficient statistics of one draw of the states of several segments, and last their log likelihood."""
    _, past, now, z, at, total = draw_states(p, xs, draws)
    return np.r_[sums(past, now, z, at, p.hyper.states), total]


def draw_weights(h: Hyper, trans: np.ndarray, betas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Shares of the states given how often each follows each: a hierarchical Dirichlet process cut off at ``states``.

    The tables behind each count are drawn one by one up to 10,000 customers and by their normal
    approximation beyond; those that stickiness explains are taken out.
    """
    n, sticky = len(betas), h.kappa * np.eye(len(betas))
    c = h.alpha * betas + sticky
    tables = np.zeros((n, n))
    for i, j in zip(*np.nonzero(trans > 0)):
        m, a = int(trans[i, j]), c[i, j]
        k = np.arange(min(m, 10_000))
        t = (rng.random(len(k)) < a / (a + k)).sum()
        if m > len(k):
            mean = a * np.log((a + m) / (a + len(k)))
            t += max(0.0, rng.normal(mean, np.sqrt(max(mean, 1e-12))))
        tables[i, j] = max(t, 1)
    own = np.round(np.diag(tables)).astype(int)
    tables[np.diag_indices(n)] -= rng.binomial(own, h.kappa / (h.kappa + h.alpha * betas))
    return np.maximum(rng.dirichlet(h.gamma / n + np.maximum(tables, 0).sum(0)), 1e-12)


def draw_params(h: Hyper, stats: np.ndarray, dims: int, rng: np.random.Generator, betas: np.ndarray | None = None) -> Params:
    """Parameters given sufficient statistics and the shares of the states before."""
    n, d, f = h.states, dims, dims * h.lags + 1
    trans = stats[: n * n].reshape(n, n)
    betas = draw_weights(h, trans, np.full(n, 1 / n) if betas is None else betas, rng)
    pi = np.stack([rng.dirichlet(trans[i] + h.alpha * betas + h.kappa * (np.arange(n) == i)) for i in range(n)])
    pi = np.maximum(pi, 1e-200)  # with many states a share may round to 0 and leave a row without any way on
    ab, q, at = np.empty((n, d, f)), np.empty((n, d, d)), n * n
    m0 = np.zeros((d, f))
    m0[:, d * (h.lags - 1) : d * h.lags] = np.eye(d)
    for k in range(n):
        pp, at = stats[at : at + f * f].reshape(f, f), at + f * f
        np_, at = stats[at : at + d * f].reshape(d, f), at + d * f
        nn, at = stats[at : at + d * d].reshape(d, d), at + d * d
        cnt, at = stats[at], at + 1
        prec = pp + np.eye(f) / h.k0
        lin = np_ + m0 / h.k0
        root = np.linalg.cholesky((prec + prec.T) / 2)
        mean = np.linalg.solve(prec, lin.T).T
        scale = h.s0 * np.eye(d) + nn + m0 @ m0.T / h.k0 - mean @ lin.T
        scale = (scale + scale.T) / 2 + 1e-6 * np.eye(d)
        c = np.linalg.cholesky(np.linalg.inv(scale))
        df = d + 2 + cnt
        tri = np.tril(rng.standard_normal((d, d)), -1) + np.diag(np.sqrt(rng.chisquare(df - np.arange(d))))
        w = c @ tri
        q[k] = np.linalg.inv(w @ w.T)
        ab[k] = mean + np.linalg.cholesky(q[k]) @ rng.standard_normal((d, f)) @ np.linalg.inv(root)
    if not all(np.isfinite(a).all() for a in (pi, ab, q)):
        raise FloatingPointError("the sampler met a value that is not finite")
    return Params(pi, ab, q, h, betas)


def _groups(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(recording, seg, frame of rows)`` per segment; a segment's length bounds the group."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        return work(key[0], int(key[1]), g.sort_values("pos"))

    return rows.groupBy("recording", "seg").applyInPandas(run, schema)


def _x(g: pd.DataFrame) -> np.ndarray:
    return np.array(g["x"].tolist(), float)


def fit(rows: DataFrame, hyper: Hyper, dims: int, iterations: int = 50, seed: int = 0, start: Params | None = None, save_every: int = 0, folder: str | None = None) -> tuple[Params, list[float]]:
    """Gibbs sampling over ``rows`` (recording, seg, pos, x): the last parameters and each iteration's log likelihood.

    Segments are gathered once, a row each. A task adds its statistics up, and so do the tasks in a
    fixed order. With ``folder`` the parameters are written every ``save_every`` iterations as parquet
    partitions iter=<n>. A value that is not finite ends the sampling with a warning; what came before is returned.
    """
    p, trace = start or initial(hyper, dims, seed), []
    n, f = hyper.states, dims * hyper.lags + 1
    width = n * n + n * (f * f + dims * f + dims * dims + 1) + 1
    lines = spread(rows.select("recording", "seg", "pos", "x"), "recording", "seg").groupBy("recording", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("x"))
    lines = durable(lines.where(F.size("x") > hyper.lags + 1).sortWithinPartitions("recording", "seg"))
    for it in range(iterations):
        q = p

        def work(batches, q=q, it=it):
            total, xs, draws, held = np.zeros(width), [], [], 0
            for b in batches:
                for rec, seg, x in zip(b["recording"], b["seg"], b["x"]):
                    xs.append(np.array(x.tolist(), float))
                    draws.append(np.random.default_rng([seed, it, int(seg), *rec.encode()[-8:]]))
                    held += len(x)
                    if held >= 20_000:
                        total, xs, draws, held = total + _sweep(q, xs, draws), [], [], 0
            if xs:
                total = total + _sweep(q, xs, draws)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "s": [total]})

        def add(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [g["part"].min()], "s": [np.sum(np.stack(g.sort_values("part")["s"].tolist()), 0)]})

        parts = lines.mapInPandas(work, "part int, s array<double>").groupBy(F.pmod("part", F.lit(8))).applyInPandas(add, "part int, s array<double>").collect()  # at most 8 rows
        sums = sum((np.array(r.s) for r in sorted(parts, key=lambda r: r.part)), np.zeros(width))
        trace.append(float(sums[-1]))
        try:
            p = draw_params(hyper, sums[:-1], dims, np.random.default_rng([seed, it]), p.betas)
        except (FloatingPointError, np.linalg.LinAlgError) as e:
            warnings.warn(f"iteration {it}: {e}; the fit stops here", stacklevel=2)
            break
        if folder and save_every and (it + 1) % save_every == 0:
            save(rows.sparkSession, p, folder, it + 1)
    return p, trace


def save(spark, p: Params, folder: str, iteration: int) -> None:
    row = [(p.pi.tolist(), p.ab.tolist(), p.q.tolist(), p.hyper.lags, None if p.betas is None else p.betas.tolist())]
    spark.createDataFrame(row, "pi array<array<double>>, ab array<array<array<double>>>, q array<array<array<double>>>, lags int, betas array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/iter={iteration}")


def load(spark, folder: str, hyper: Hyper, iteration: int | None = None) -> Params:
    """Parameters of an iteration, by default the last."""
    df = spark.read.parquet(folder)
    it = iteration if iteration is not None else df.agg(F.max("iter")).first()[0]
    r = df.where(F.col("iter") == it).first()
    if r is None:
        raise ValueError(f"no snapshot of iteration {it}")
    return Params(np.array(r.pi), np.array(r.ab), np.array(r.q), replace(hyper, lags=r.lags, states=len(r.pi)), None if r.betas is None else np.array(r.betas))


def apply(rows: DataFrame, p: Params, iterations: int = 1, seed: int = 0) -> DataFrame:
    """States under fixed parameters: recording, pos, syllable; the first ``lags`` rows repeat the first state."""

    def work(rec: str, seg: int, g: pd.DataFrame) -> pd.DataFrame:
        x, lags = _x(g), p.hyper.lags
        if len(x) <= lags:
            return pd.DataFrame({"recording": rec, "pos": g["pos"], "syllable": 0})
        z = np.zeros(0)
        for it in range(iterations):
            z = sample_states(p, x, np.random.default_rng([seed, it, seg, *rec.encode()[-8:]]))
        return pd.DataFrame({"recording": rec, "pos": g["pos"], "syllable": np.r_[np.repeat(z[0], lags), z]})

    return _groups(rows, work, "recording string, pos bigint, syllable int")


def state_marginals(rows: DataFrame, p: Params) -> DataFrame:
    """Posterior probability of every state: recording, pos, marginal array<double>."""

    def work(rec: str, seg: int, g: pd.DataFrame) -> pd.DataFrame:
        x, lags = _x(g), p.hyper.lags
        if len(x) <= lags:
            return pd.DataFrame({"recording": rec, "pos": g["pos"], "marginal": [[1 / p.hyper.states] * p.hyper.states] * len(g)})
        m = marginals(p, x)
        m = np.r_[np.repeat(m[:1], lags, 0), m]
        return pd.DataFrame({"recording": rec, "pos": g["pos"], "marginal": m.tolist()})

    return _groups(rows, work, "recording string, pos bigint, marginal array<double>")


def expected_likelihoods(rows: DataFrame, models: list[Params]) -> DataFrame:
    """How well each model explains the data: model, score, standard error over segments of the mean log likelihood per frame."""

    def work(rec: str, seg: int, g: pd.DataFrame) -> pd.DataFrame:
        x = _x(g)
        ok = [(i, forward(m, log_likelihoods(m, x))[1] / len(x)) for i, m in enumerate(models) if len(x) > m.hyper.lags]
        return pd.DataFrame(ok, columns=["model", "ll"])

    return _groups(rows, work, "model int, ll double").groupBy("model").agg(F.avg("ll").alias("score"), (F.stddev_samp("ll") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))


def cross_likelihoods(latents: list[DataFrame], models: list[Params]) -> DataFrame:
    """model, score, standard_error: mean and error over j of the log likelihood of model j's latents (recording, seg, pos, x) under every other model i.

    Likelihoods are summed over segments: one term per ordered pair of models.
    """
    n = len(models)

    def against(j: int) -> DataFrame:
        def work(rec: str, seg: int, g: pd.DataFrame) -> pd.DataFrame:
            x = _x(g)
            ok = [(i, j, forward(m, log_likelihoods(m, x))[1]) for i, m in enumerate(models) if i != j and len(x) > m.hyper.lags]
            return pd.DataFrame(ok, columns=["model", "other", "ll"])

        return _groups(latents[j], work, "model int, other int, ll double")

    table = reduce(DataFrame.unionByName, [against(j) for j in range(n)]).groupBy("model", "other").agg(F.sum("ll").alias("ll"))
    return table.groupBy("model").agg(F.avg("ll").alias("score"), (F.stddev_pop("ll") / np.sqrt(max(n - 1, 1))).alias("standard_error"))


def permute(p: Params, order: list[int]) -> Params:
    """The same model with its states renumbered: state ``order[i]`` becomes i."""
    o = np.asarray(order)
    return Params(p.pi[np.ix_(o, o)], p.ab[o], p.q[o], p.hyper, None if p.betas is None else p.betas[o])


def snapshots(spark, folder: str) -> list[int]:
    """Iterations that were saved, rising."""
    return sorted(r.iter for r in spark.read.parquet(folder).select("iter").distinct().collect())  # one per snapshot


def truncate(spark, folder: str, last: int) -> list[int]:
    """Delete the snapshots after iteration ``last``, as a restart from there does; returns those deleted."""
    gone = [i for i in snapshots(spark, folder) if i > last]
    jvm = spark.sparkContext._jvm
    for i in gone:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/iter={i}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def relabel_snapshots(spark, folder: str, hyper: Hyper, order: list[int], states: DataFrame | None = None) -> DataFrame | None:
    """Renumber the states of every saved snapshot and of ``states`` (iter, ..., syllable): state ``order[i]`` becomes i.

    Labels of ``states`` beyond the model's are refused.
    """
    for i in snapshots(spark, folder):
        save(spark, permute(load(spark, folder, hyper, i), order), folder, i)
    if states is None:
        return None
    new = F.array_position(F.array(*[F.lit(int(o)) for o in order]), F.col("syllable")) - 1
    known = F.when(F.col("syllable").isNull() | (new >= 0), new.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no state of the model: "), F.col("syllable").cast("string"))).cast("int"))
    return states.withColumn("syllable", known)


def sorted_scores(scores: DataFrame) -> DataFrame:
    """Models by rising score, for plotting: model, score, standard_error, rank (one row per model)."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy("score", "model")) - 1)


def kappa_summary(snapshots: DataFrame) -> DataFrame:
    """Median run length per (kappa, iter). ``snapshots``: kappa, iter, recording, pos, n, syllable."""
    from gaitloom.operators.timeline import runs

    tagged = snapshots.withColumn("_r", F.concat_ws("|", "kappa", "iter", "recording"))
    r = runs(tagged.select(F.col("_r").alias("recording"), "pos", "n", "syllable"))
    part = F.split("recording", r"\|")
    return r.groupBy(F.get(part, F.lit(0)).cast("double").alias("kappa"), F.get(part, F.lit(1)).cast("int").alias("iter")).agg(F.median(F.col("end") - F.col("start")).alias("median_duration"))


def reconstruct(rows: DataFrame, loadings: np.ndarray, keypoints: int) -> DataFrame:
    """Adds ``pose``: keypoints of a row's latent state ``x`` at centroid ``v`` and heading ``h``.

    ``loadings`` is (keypoints * 2, dims + 1), the last column the mean pose.
    """
    m = [[float(w) for w in r] for r in loadings]
    dot = lambda r: F.aggregate(F.zip_with(F.concat("x", F.array(F.lit(1.0))), F.array(*[F.lit(w) for w in m[r]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    flat = F.array(*[dot(i) for i in range(2 * keypoints)])
    c, s = F.cos("h"), F.sin("h")

    def place(k):
        x, y = F.get("_y", 2 * k), F.get("_y", 2 * k + 1)
        return F.array(c * x - s * y + F.get("v", F.lit(0)), s * x + c * y + F.get("v", F.lit(1)))

    return rows.withColumn("_y", flat).withColumn("pose", F.transform(F.sequence(F.lit(0), F.lit(keypoints - 1)), place)).drop("_y")


def history(snapshots: DataFrame, recording: str, start: int, length: int) -> DataFrame:
    """The same stretch of one recording over all snapshots: iter, pos, syllable."""
    return snapshots.where((F.col("recording") == recording) & (F.col("pos") >= start) & (F.col("pos") < start + length)).select("iter", "pos", "syllable")
