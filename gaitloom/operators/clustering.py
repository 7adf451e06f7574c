"""Hierarchical clustering of a model's syllables: at most a few hundred, on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def linkage(distance: np.ndarray, method: str = "complete") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size); clusters n, n+1, ... arise in order. Methods: complete, single, average, ward.

    Ties fall to the pair with the least numbers.
    """
    n = len(distance)
    d = {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    size, alive, out = {i: 1 for i in range(n)}, set(range(n)), []
    while len(alive) > 1:
        (a, b), h = min(d.items(), key=lambda e: (e[1], e[0]))
        new, na, nb = n + len(out), size[a], size[b]
        for k in alive - {a, b}:
            x, y = d.pop((min(a, k), max(a, k))), d.pop((min(b, k), max(b, k)))
            nk = size[k]
            if method == "complete":
                v = max(x, y)
            elif method == "single":
                v = min(x, y)
            elif method == "average":
                v = (na * x + nb * y) / (na + nb)
            elif method == "ward":
                v = np.sqrt(((na + nk) * x * x + (nb + nk) * y * y - nk * h * h) / (na + nb + nk))
            else:
                raise ValueError(f"unknown method {method}")
            d[k, new] = float(v)
        del d[a, b]
        alive = (alive - {a, b}) | {new}
        size[new] = na + nb
        out.append((a, b, h, na + nb))
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right."""
    if n < 2:
        return list(range(n))
    out, stack = [], [n + len(merges) - 1]
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            a, b = merges[k - n][:2]
            stack += [b, a]
    return out


def dendrogram(pairs: DataFrame, method: str = "complete") -> DataFrame:
    """Merges of the syllables in ``pairs`` (a, b, distance): step, left, right, height, size, by cluster number; leaves by rank of label."""
    rows = pairs.select("a", "b", "distance").collect()  # the square of a model's labels
    labels = sorted({r.a for r in rows})
    at = {s: i for i, s in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    for r in rows:
        m[at[r.a], at[r.b]] = r.distance if r.distance is not None else 1.0
    merges = [(i, int(a), int(b), float(h), int(s)) for i, (a, b, h, s) in enumerate(linkage((m + m.T) / 2, method))]
    return pairs.sparkSession.createDataFrame(merges, "step int, left int, right int, height double, size int")
