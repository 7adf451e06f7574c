"""NumPy side of the spike operator: features of readings, and isolation trees over their codes.

Rows are frames sorted by (group, frame); a group is one recording's block with its margins.
All arrays hold every group of a batch at once, so the cost is per reading, not per recording.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Frames looked at on either side of every reading, and of a reading that departs.
REACH, FAR = 4, 6
#: Readings that may share a spike: a difference is taken to the readings up to so many rows before and after.
SHARE = 3
#: Lag of the seasonal comparison in seconds (a stride or a breath), and frames a second where they are unknown.
PERIOD, FPS = 0.4, 30.0
#: Frames a block borrows on either side. Runs are seen up to that far beyond the block, many times what a frozen stretch needs.
MARGIN = 128
#: A neighbour is used if no more than this many frame numbers are absent before it.
HOLE = 4
#: Steps no larger than this share of the block's usual step repeat the value.
STILL = 0.05
#: Each feature is placed between what half of all readings reach or so and what leaves no doubt, in units of its usual size in the block.
RAMPS = {"level": (2.5, 18.0), "whole": (2.5, 20.0), "diff": (3.5, 20.0), "season": (4.0, 36.0), "run": (2.0, 12.0)}
CONF_RAMPS = {"level": (2.0, 16.0), "diff": (2.5, 14.0), "season": (8.0, 30.0), "run": (2.0, 12.0)}
#: Places on a feature's scale; 0 is ordinary.
PLACES = 9
NAMES = ("level", "whole", "diff", "season", "run")
CODES = PLACES ** len(NAMES)
#: Departures with nothing on one side count for less, as movement explains more of them.
ONE_SIDED = 0.4


def _shift(a: np.ndarray, k: int, fill: float) -> np.ndarray:
    out = np.full_like(a, fill)
    if k > 0:
        out[:-k] = a[k:]
    elif k < 0:
        out[-k:] = a[:k]
    return out


def reachable(gid: np.ndarray, frame: np.ndarray, k: int) -> np.ndarray:
    """Whether row i+k is of the same group and near enough in time to say something about row i."""
    n, ok = len(gid), np.zeros(len(gid), bool)
    if abs(k) < n:
        a, b = (slice(0, n - k), slice(k, n)) if k > 0 else (slice(-k, n), slice(0, n + k))
        ok[a] = (gid[a] == gid[b]) & (np.abs(frame[b] - frame[a]) <= abs(k) + HOLE)
    return ok


#: Compare-and-swap steps that sort eight values.
NETWORK = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (1, 2), (5, 6), (0, 4), (1, 5), (2, 6), (3, 7), (2, 4), (3, 5), (1, 2), (3, 4), (5, 6)]


def _middle(cols: list[np.ndarray]) -> np.ndarray:
    """Median along a list of equally shaped arrays, NaN being missing; NaN where nothing is there.

    Missing values become minus and plus infinity in turn, which keeps the middle in the middle.
    """
    low = np.zeros(cols[0].shape, bool)
    full = []
    for w in cols:
        miss = np.isnan(w)
        if miss.any():
            w = np.where(miss, np.where(low, np.float32(np.inf), np.float32(-np.inf)), w)
            low ^= miss
        full.append(w)
    if len(full) == 8:
        for i, j in NETWORK:
            full[i], full[j] = np.minimum(full[i], full[j]), np.maximum(full[i], full[j])
    else:
        full = list(np.sort(np.stack(full), axis=0))
    a, b = full[(len(full) - 1) // 2], full[len(full) // 2]
    fa, fb = np.isfinite(a), np.isfinite(b)
    with np.errstate(invalid="ignore"):
        mid = (a + b) / 2
    return np.where(fa & fb, mid, np.where(fa, a, np.where(fb, b, np.float32(np.nan))))


def _neighbours(v: np.ndarray, oks: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """The rows around each row; NaN where there is none of the same course. ``v``: (rows, columns)."""
    out = []
    for k, ok in oks:
        w = _shift(v, k, np.nan)
        w[~ok] = np.nan
        out.append(w)
    return out


def usual(gid: np.ndarray, v: np.ndarray, q: float) -> np.ndarray:
    """Per row the quantile ``q`` of its group's finite values, as a column; infinity where it has none."""
    start = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    out = np.full(len(start), np.inf, np.float32)
    for i, (a, b) in enumerate(zip(start, np.r_[start[1:], len(gid)])):
        x = v[a:b].ravel()
        x = x[np.isfinite(x)]
        if len(x):
            k = int(q * (len(x) - 1))
            out[i] = np.partition(x, k)[k]
    return np.repeat(out, np.diff(np.r_[start, len(gid)]))[:, None]


def run_lengths(v: np.ndarray, gid: np.ndarray, tol: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the length of its run of repeated readings, and whether it is the run's first.

    ``v`` is (rows, cells, coordinates); ``tol`` one number or one a row. Missing readings are
    skipped: they neither end nor lengthen a run.
    """
    n, cells = v.shape[:2]
    w = np.ascontiguousarray(v.swapaxes(0, 1)).reshape(n * cells, -1)
    there = np.flatnonzero(~np.isnan(w).any(1))
    length, first = np.zeros(n * cells, np.int32), np.zeros(n * cells, bool)
    if len(there):
        x, row = w[there], there % n
        g = gid[row]
        tol = np.broadcast_to(np.asarray(tol, np.float32), (n,))[row[1:], None]
        new = np.ones(len(there), bool)
        new[1:] = (np.abs(x[1:] - x[:-1]) > tol).any(1) | (g[1:] != g[:-1]) | (there[1:] // n != there[:-1] // n)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(there)])
        length[there], first[there] = np.repeat(size, size), new
    return length.reshape(cells, n).T, first.reshape(cells, n).T


def _two_sided(v: np.ndarray, gid: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Of the readings up to ``SHARE`` rows away the largest distance on either side, the lesser side counting.

    A spike shared by a few rows is far from something on both sides, a lasting change on one only.
    """
    sides = []
    for sign in (-1, 1):
        far = None
        for w in _neighbours(v, [(sign * k, reachable(gid, frame, sign * k)) for k in range(1, SHARE + 1)]):
            d = np.abs(v - w)
            far = d if far is None else np.fmax(far, d)
        sides.append(far)
    return np.minimum(*sides)


def _seasonal(v: np.ndarray, gid: np.ndarray, frame: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """The lesser distance to the readings ``lag`` rows before and after (``lag`` per row)."""
    n, i = len(gid), np.arange(len(gid))
    out = None
    for j in (i - lag, i + lag):
        jj = np.clip(j, 0, n - 1)
        ok = (j >= 0) & (j < n) & (gid[jj] == gid) & (np.abs(frame[jj] - frame) <= lag + HOLE)
        d = np.abs(v - v[jj])
        d[~ok] = np.nan
        out = d if out is None else np.minimum(out, d)
    return out


def _views(at: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least distance from the surroundings before, after and on both sides, and whether one side is empty."""
    least, empty = np.full(len(at), np.inf, np.float32), np.zeros(len(at), bool)
    for part in (slice(0, FAR), slice(FAR, None), slice(None)):
        m = np.stack([_middle([around[:, i, d] for i in range(*part.indices(2 * FAR))]) for d in range(at.shape[1])], -1)
        d = np.sqrt(((at - m) ** 2).sum(-1))
        least = np.fmin(least, d)
        if part != slice(None):
            empty |= np.isnan(d)
    return np.where(np.isfinite(least), least, np.float32(0)), empty


def _around(gid: np.ndarray, frame: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers around the rows ``r`` and whether they say something about them."""
    n, off = len(gid), np.array([k for k in range(-FAR, FAR + 1) if k])
    j = r[:, None] + off
    jj = np.clip(j, 0, n - 1)
    return jj, (j >= 0) & (j < n) & (gid[jj] == gid[r][:, None]) & (np.abs(frame[jj] - frame[r][:, None]) <= np.abs(off) + HOLE)


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v**2).sum(-1))


def features(gid: np.ndarray, frame: np.ndarray, pose: np.ndarray, conf: np.ndarray, lag: np.ndarray) -> dict[str, dict[str, np.ndarray]]:
    """Features of every reading, in units of their usual size in the reading's block, by field.

    ``pose`` (rows, k, 2) and ``conf`` (rows, k): float32, NaN where unusable; ``lag`` rows of the season.

    level: departure of a position, in the image and relative to the body, from the readings before,
    after and on both sides, the least counting; of a confidence likewise. whole: the same of the
    whole animal in the image, where the cell shares in it. diff: difference to the nearest readings
    on both sides, in the image and relative to the body. season: the same at the seasonal lag. run: how many readings in a row repeat the
    value, 1 for the first of them and for confidences at the ends of their scale.
    """
    n, k = conf.shape
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        near = [(i, reachable(gid, frame, i)) for i in range(-REACH, REACH + 1) if i]
        before = [(-1, reachable(gid, frame, -1))]
        step = np.abs(pose.reshape(n, -1) - _neighbours(pose.reshape(n, -1), before)[0]).reshape(n, k, 2).max(-1)
        cstep = np.abs(conf - _neighbours(conf, before)[0])
        tol = np.nan_to_num(STILL * usual(gid, step, 0.5)[:, 0], posinf=0.0)
        ctol = np.nan_to_num(STILL * usual(gid, cstep, 0.5)[:, 0], posinf=0.0)
        prun, pfirst = run_lengths(pose, gid, tol)
        crun, cfirst = run_lengths(conf[..., None], gid, ctol)

        live = pose
        frozen = (prun >= 2 * REACH) & ~pfirst
        if frozen.any():  # a frozen stretch says nothing about its surroundings
            live = pose.copy()
            live[frozen] = np.nan
        centre = _middle([live[:, i] for i in range(k)])
        centre = np.where(np.isnan(centre), _middle([pose[:, i] for i in range(k)]), centre)
        rel, body = (pose - centre[:, None]).reshape(n, -1), (live - centre[:, None]).reshape(n, -1)
        off = (rel - _middle(_neighbours(body, near))).reshape(n, k, 2)
        # a centre moves when a cell departs or is missing; what most cells of a frame share is taken out
        shift = np.where((~np.isnan(off[..., 0])).sum(1)[:, None] > 2, np.nan_to_num(_middle([off[:, i] for i in range(k)])), 0).astype(np.float32)
        centre = centre + shift
        rel = (pose - centre[:, None]).reshape(n, -1)
        level = _length(off - shift[:, None])
        unit = np.maximum(usual(gid, level, 0.5), 1e-6)
        r, c = np.nonzero(level > RAMPS["level"][0] * unit)
        jj, ok = _around(gid, frame, r)
        image = live[jj, c[:, None]]
        image[~ok] = np.nan
        a, lone = _views(pose[r, c], image)
        b, _ = _views(pose[r, c] - centre[r], image - centre[jj])
        level[r, c] = np.fmin(level[r, c], np.minimum(a, b)) * np.where(lone, ONE_SIDED, 1)

        # the whole animal: rows whose centre departs are judged by all their cells, as centres depend on which cells are there
        moved = _length(centre - _middle(_neighbours(centre, near)))[:, None]
        wunit = np.maximum(usual(gid, _length(centre - _neighbours(centre, before)[0])[:, None], 0.5), unit)
        whole = np.zeros((n, k), np.float32)
        r = np.flatnonzero(moved[:, 0] > 0.8 * RAMPS["whole"][0] * wunit[:, 0])
        jj, ok = _around(gid, frame, r)
        if len(r):
            cells = []
            for i in range(k):
                image = live[jj, i]
                image[~ok] = np.nan
                d, lone = _views(pose[r, i], image)
                d = d * np.where(lone, ONE_SIDED, 1)
                cells.append(np.where(np.isnan(pose[r, i]).any(1), np.nan, d).astype(np.float32))
            whole[r] = np.fmin(np.stack(cells, 1), _middle(cells)[:, None])

        flat = pose.reshape(n, -1)  # a difference counts if it is there in the image too
        diff, season = (np.minimum(*(f(v).reshape(n, k, 2).max(-1) for v in (rel, flat))) for f in (lambda v: _two_sided(v, gid, frame), lambda v: _seasonal(v, gid, frame, lag)))
        p = {"level": level / unit, "whole": whole / wunit, "diff": diff / np.maximum(usual(gid, diff, 0.5), unit), "season": season / np.maximum(usual(gid, season, 0.5), unit), "run": np.where(pfirst, 1, prun)}

        clevel = np.abs(conf - _middle(_neighbours(conf, near)))
        cunit = np.maximum(usual(gid, clevel, 0.9), 1e-6)
        r, c = np.nonzero(clevel > CONF_RAMPS["level"][0] * cunit)
        jj, ok = _around(gid, frame, r)
        image = conf[jj, c[:, None]]
        image[~ok] = np.nan
        a, lone = _views(conf[r, c][:, None], image[..., None])
        clevel[r, c] = np.fmin(clevel[r, c], a) * np.where(lone, ONE_SIDED, 1)
        cdiff, cseason = _two_sided(conf, gid, frame), _seasonal(conf, gid, frame, lag)
        q = {"level": clevel / cunit, "diff": cdiff / np.maximum(usual(gid, cdiff, 0.9), cunit), "season": cseason / np.maximum(usual(gid, cseason, 0.9), cunit), "run": np.where(cfirst | (conf >= 1) | (conf <= 0), 1, crun)}
    return {"pose": p, "conf": q}


def _place(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """Place of a feature between ordinary (0) and beyond doubt (PLACES - 1): the squared share of the way, on a logarithmic scale.

    The square leaves the tail of ordinary readings little of the extent that the trees cut at random.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.log(np.nan_to_num(v, nan=0.0, posinf=1e30) / low) / np.log(high / low)
    return np.clip(np.ceil(np.maximum(x, 0) ** 2 * (PLACES - 1)), 0, PLACES - 1).astype(np.int32)


def encode(f: dict[str, np.ndarray], ramps: dict[str, tuple[float, float]]) -> np.ndarray:
    """One integer per reading: the places of its features. 0 is a reading ordinary in every way."""
    code = None
    for name in NAMES:
        p = _place(f[name], *ramps[name]) if name in ramps else 0
        code = p if code is None else code * PLACES + p
    return code


def decode(code: np.ndarray) -> np.ndarray:
    """(codes, features): places of ``NAMES``."""
    code = np.asarray(code, np.int64) % CODES
    return np.stack([code // PLACES**i % PLACES for i in range(len(NAMES))][::-1], -1)


def codes(f: dict[str, dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return encode(f["pose"], RAMPS), encode(f["conf"], CONF_RAMPS) + CODES


# --- isolation trees -------------------------------------------------------------------------


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` readings, n > 0 (continuous in n; 0 up to one reading)."""
    n = np.maximum(np.asarray(n, np.float64), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


@lru_cache(maxsize=8)
def _trees(trees: int, depth: int, field: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of every inner node of ``trees`` full trees, in heap order.

    A node splits a random feature at a random value of the node's extent. The extents start from
    the whole scale of each feature rather than from the extremes of a sample: a recording without
    implausible readings then sets none apart, and all recordings can share the trees' shape. What
    differs is how a recording's readings fill them.
    """
    rng = np.random.default_rng(seed + field)
    use = [i for i, n in enumerate(NAMES) if n in (CONF_RAMPS if field else RAMPS)]
    nodes = (1 << depth) - 1
    feat, cut = np.array(use)[rng.integers(0, len(use), (trees, nodes))], np.zeros((trees, nodes))
    lo, hi = np.zeros((trees, 2 * nodes + 1, len(NAMES))), np.full((trees, 2 * nodes + 1, len(NAMES)), float(PLACES - 1))
    t = np.arange(trees)
    for i in range(nodes):
        f = feat[:, i]
        cut[:, i] = lo[t, i, f] + rng.random(trees) * (hi[t, i, f] - lo[t, i, f])
        for child in (2 * i + 1, 2 * i + 2):
            lo[:, child], hi[:, child] = lo[:, i], hi[:, i]
        hi[t, 2 * i + 1, f] = cut[:, i]
        lo[t, 2 * i + 2, f] = cut[:, i]
    return feat, cut


def leaves(code: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """(codes, trees): number of the leaf at ``depth`` that a code falls into."""
    code = np.asarray(code)
    out = np.zeros((len(code), trees), np.int64)
    t = np.arange(trees)
    for field in (0, 1):
        m = np.flatnonzero((code >= CODES) == bool(field))
        if not len(m):
            continue
        feat, cut = _trees(trees, depth, field, seed)
        x, node = decode(code[m]), np.zeros((len(m), trees), np.int64)
        i = np.arange(len(m))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[i, feat[t, node]] > cut[t, node])
        out[m] = node - ((1 << depth) - 1)
    return out


def isolation_scores(group: np.ndarray, leaf: np.ndarray, count: np.ndarray, depth: int, sample: int) -> np.ndarray:
    """Isolation score of each code of each group (one recording's field), between 0 and 1; 0.5 is the bulk.

    ``count``: readings of the code. All readings of a group fill the trees; their numbers are scaled to a
    sample of ``sample``. A code's path in a tree ends where depth plus the mean search among the readings
    that share the node is least: at once where the node is all but empty. No reading goes unscored.
    """
    g = np.unique(group, return_inverse=True)[1]
    share = count / np.bincount(g, weights=count)[g] * sample
    trees = leaf.shape[1]
    key = g[:, None] * trees + np.arange(trees)
    path = np.full(leaf.shape, float(_harmonic(np.array(sample))))
    for d in range(1, depth + 1):
        at = (key << d) + (leaf >> (depth - d))
        mass = np.bincount(at.ravel(), weights=np.repeat(share, trees), minlength=0)[at] if at.size else np.zeros(at.shape)
        path = np.minimum(path, d + _harmonic(mass))
    return 2.0 ** (-path.mean(1) / max(float(_harmonic(np.array(sample))), 1e-9))
