"""Hartigan's dip of a weighted sample, and counts of normal components by BIC: kernels for one group's binned values."""

from __future__ import annotations

import math

import numpy as np

#: Sizes of the uniform samples that p-values come from, and how many are drawn of each.
NULL_SIZES, NULL_DRAWS = (20, 40, 80, 160, 320, 640, 1280), 1000
#: Least share of a normal's variance in that of all values, and steps and gain of the fit.
VARIANCE_FLOOR, EM_STEPS, EM_GAIN = 1e-6, 300, 1e-7


def hull(x: np.ndarray, y: np.ndarray, sign: float = 1.0) -> np.ndarray:
    """Indices of the corners of the greatest convex minorant of the points; ``sign`` -1: of the least concave majorant."""
    xs, ys = x.tolist(), (sign * y).tolist()
    out: list[int] = []
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        while len(out) > 1:
            p, q = out[-2], out[-1]
            if (ys[q] - ys[p]) * (a - xs[q]) >= (b - ys[q]) * (xs[q] - xs[p]):
                out.pop()
            else:
                break
        out.append(i)
    return np.array(out)


def dip(x: np.ndarray, weight: np.ndarray | None = None, n: float | None = None) -> float:
    """The greatest distance of a sample's distribution function from the nearest unimodal one.

    ``x`` are its values, ``weight`` how often each occurs, ``n`` their number (1 / 2n is the least dip). The modal interval shrinks
    to where the convex minorant from the left and the concave majorant from the right are farthest apart, until what lies
    outside deviates more than what lies within.
    """
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    x, at = np.unique(np.asarray(x, float), return_inverse=True)
    weight = np.bincount(at, weight)
    total = weight.sum()
    after = np.cumsum(weight) / total
    return _dip(x, after - weight / total, after, 1 / (n or total))


def knot_dip(knots: np.ndarray, n: float) -> float:
    """The dip of a large sample of ``n`` values from its quantiles at equal steps from 0 to 1, between which its distribution function is taken for straight; knots that
    coincide are a jump of it."""
    x, first, times = np.unique(np.asarray(knots, float), return_index=True, return_counts=True)
    step = 1 / (len(knots) - 1)
    before = first * step
    return _dip(x, before, before + (times - 1) * step, 1 / n)


def _dip(x: np.ndarray, before: np.ndarray, after: np.ndarray, depth: float) -> float:
    """``before`` and ``after`` are the distribution function at each of ``x``, below and above its jump; twice the result is ``depth`` at least."""
    low, high = 0, len(x) - 1
    while low < high:
        own, lo, hi = x[low : high + 1], before[low : high + 1], after[low : high + 1]
        g, u = hull(own, lo), hull(own, hi, -1.0)
        convex, concave = np.interp(own, own[g], lo[g]), np.interp(own, own[u], hi[u])
        corners = np.union1d(g, u)
        gap = concave[corners] - convex[corners]
        best = int(corners[gap.argmax()])
        if gap.max() <= depth + 1e-14:
            break
        # the corner where both are farthest apart, and the next corner of the other curve beyond it
        left = best if best in g else int(g[np.searchsorted(g, best) - 1])
        right = best if best in u else int(u[np.searchsorted(u, best)])
        # the end of the modal interval may be a jump of the distribution itself
        below = (hi - convex)[:left].max(initial=0.0)
        above = (concave - lo)[right + 1 :].max(initial=0.0)
        depth = max(depth, below, above)
        if (left, right) == (0, len(own) - 1):
            break
        low, high = low + left, low + right
    return depth / 2


def null_dips(size: int, seed: int) -> float:
    """sqrt(size) times the dip of one seeded uniform sample."""
    return math.sqrt(size) * dip(np.random.default_rng((size, seed)).random(size))


def dip_p_value(value: float, n: float, nulls: dict[int, np.ndarray]) -> float:
    """Share of uniform samples of size ``n`` whose dip is no smaller; between the drawn sizes it is interpolated, beyond the
    largest it is that of the largest, as sqrt(n) times the dip settles. ``nulls``: sorted null_dips by size."""
    sizes = np.array(sorted(nulls))
    scaled = math.sqrt(n) * value
    shares = [1 - np.searchsorted(nulls[s], scaled, "left") / len(nulls[s]) for s in sizes]
    return float(np.interp(math.log(n), np.log(sizes), shares))


def normal_mixture(x: np.ndarray, weight: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, shares, means, deviations) of ``k`` normals fitted to weighted values by EM.

    It starts from the split of the values into ``k`` runs with the least squared deviations that Lloyd's steps find from quantiles.
    """
    total = weight.sum()
    order = np.argsort(x)
    x, weight = x[order], weight[order]
    upto = (np.cumsum(weight) - weight / 2) / total
    means = np.interp((np.arange(k) + 0.5) / k, upto, x)
    for _ in range(100):
        near = np.abs(x[:, None] - means).argmin(1)
        sums = np.bincount(near, weight, k)
        moved = np.where(sums > 0, np.bincount(near, weight * x, k) / np.maximum(sums, 1e-300), means)
        if np.allclose(moved, means, rtol=0, atol=1e-12):
            break
        means = moved
    spread = np.average((x - np.average(x, weights=weight)) ** 2, weights=weight)
    floor = VARIANCE_FLOOR * spread
    near = np.abs(x[:, None] - means).argmin(1)
    shares = np.maximum(np.bincount(near, weight, k) / total, 1e-12)
    var = np.bincount(near, weight * (x - means[near]) ** 2, k) / np.maximum(shares * total, 1e-300) + floor
    last = -math.inf
    for _ in range(EM_STEPS):  # a row a normal
        off = (x - means[:, None]) ** 2
        logs = (np.log(shares) - 0.5 * np.log(2 * np.pi * var))[:, None] - 0.5 * off / var[:, None]
        top = logs.max(0)
        share = np.exp(logs - top)
        sums = share.sum(0)
        score = float(weight @ (top + np.log(sums)))
        if score - last < EM_GAIN * total:
            break
        last = score
        share *= weight / sums
        sums = np.maximum(share.sum(1), 1e-300)
        shares, means = np.maximum(sums / total, 1e-12), share @ x / sums
        var = (share * (x - means[:, None]) ** 2).sum(1) / sums + floor
    return score, shares, means, np.sqrt(var)


def n_components(x: np.ndarray, weight: np.ndarray, most: int = 4) -> int:
    """The number of normals, from 2, with the least BIC."""
    n = weight.sum()
    bic = {k: (3 * k - 1) * math.log(n) - 2 * normal_mixture(x, weight, k)[0] for k in range(2, most + 1) if k < n}
    return min(bic, key=bic.get) if bic else 2
