"""Trees over binned features, grown a level at a time: all nodes of a level are split by a few counts over rows."""

from __future__ import annotations

import numpy as np

BINS = 64
# How likely a row is drawn at most 0, 1, 2, ... times when n rows are drawn from n (Poisson with mean 1).
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def scrambled(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values (the public splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is in the bag of a tree: it follows from seed, tree and row alone."""
    with np.errstate(over="ignore"):
        key = scrambled(scrambled(np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1)) ^ rows.astype(np.uint64))
    return np.searchsorted(DRAWN, (key >> np.uint64(11)) / 2.0**53, side="right")


def bag_weights(times: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of rows in a bag, so that both classes of this bag weigh the same: n / (2 n of the class) for each time a row is in it."""
    n = np.array([times[y == 0].sum(), times[y == 1].sum()], float)
    return times * np.divide(n.sum(), 2 * n, out=np.zeros(2), where=n > 0)[y]


def borders(x: np.ndarray) -> list[np.ndarray]:
    """For each column at most ``BINS - 1`` borders at quantiles of its values; a value is in the bin of the first border that is not below it."""
    marks = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(c, marks, method="inverted_cdf")) for c in x.T]


def binned(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, c, side="left") for b, c in zip(at, x.T, strict=True)], axis=1).astype(np.uint8) if len(at) else np.zeros((len(x), 0), np.uint8)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int | None, leaf: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree as arrays: feature (-1 in leaves), bin (rows up to it go left), left child (the right one follows it), share of class 1.

    Each node tries sqrt(features) of them in an order of its own, and goes on
    while none of these divides it. Every child has at least ``leaf`` rows.
    """
    n_features = bins.shape[1]
    tries = max(1, int(np.sqrt(n_features)))
    rows = np.flatnonzero(weight > 0)
    node = np.zeros(len(rows), np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    made, level = 1, 0
    while True:
        n = int(node.max()) + 1 if len(node) else 1
        ones, w = weight[rows] * y[rows], weight[rows]
        total1, total = np.bincount(node, ones, n), np.bincount(node, w, n)
        size = np.bincount(node, minlength=n)
        share = np.divide(total1, total, out=np.zeros(n), where=total > 0)
        feature, cut = np.full(n, -1), np.zeros(n, np.int64)
        may = (total1 > 0) & (total1 < total) & (size >= 2 * leaf) & (depth is None or level < depth)
        best = np.full(n, -np.inf)
        order = rng.random((n, n_features)).argsort(axis=1)
        for k in range(n_features):
            live = may & ((feature < 0) | (k < tries))
            if not live.any():
                break
            own = live[node]
            at, f = node[own], order[node[own], k]
            key = at * BINS + bins[rows[own], f]
            left1, left, count = (np.bincount(key, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (ones[own], w[own], np.ones(len(at))))
            right, right1 = total[:, None] - left, total1[:, None] - left1
            fits = (count >= leaf) & (size[:, None] - count >= leaf) & live[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, (left1**2 + (left - left1) ** 2) / left + (right1**2 + (right - right1) ** 2) / right, -np.inf)
            b = gain.argmax(1)
            g = gain[np.arange(n), b]
            better = g > best
            best[better], feature[better], cut[better] = g[better], order[better, k], b[better]
        split = feature >= 0
        left_of = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        parts.append((feature, cut, left_of, share))
        if not split.any():
            break
        made += 2 * int(split.sum())
        stays = split[node]
        rows, node = rows[stays], node[stays]
        node = (left_of[node] - left_of[split][0]) + (bins[rows, feature[node]] > cut[node])
        level += 1
    f, c, left, s = (np.concatenate(p) for p in zip(*parts, strict=True))
    return {"feature": f.astype(np.int32), "cut": c.astype(np.int32), "left": left.astype(np.int32), "share": s.astype(np.float32)}


def score(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The share of class 1 in each row's leaf."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        f = tree["feature"][at]
        moves = f >= 0
        if not moves.any():
            return tree["share"][at].astype(float)
        here = at[moves]
        at[moves] = tree["left"][here] + (bins[rows[moves], f[moves]] > tree["cut"][here])
