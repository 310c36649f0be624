"""Estimators for one slice of a series, on arrays: what a task of the walk-forward fits.

A slice has some thousand rows, so a whole fit is one task, and slices, folds and candidates are what is spread over
the cluster. For one fit over many rows there is models.py. All take x (rows, features), y (class numbers 0, 1, 2)
and give probabilities (rows, 3); a class that is not in the slice has probability 0.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

CLASSES = 3
BINS = 64


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Prior:
    """Class shares of the slice."""

    def fit(self, x, y, rng):
        self.p = np.bincount(y, minlength=CLASSES) / max(len(y), 1)
        return self

    def predict(self, x):
        return np.tile(self.p, (len(x), 1))


@dataclass
class Logistic:
    """Multinomial, on standardised features: C times the (weighted) log loss plus half the squared coefficients, by Newton's method."""

    c: float = 1.0
    balanced: bool = False

    def fit(self, x, y, rng):
        self.mean, self.sd = x.mean(0), x.std(0)
        self.sd = np.where(self.sd > 0, self.sd, 1.0)
        self.seen = np.flatnonzero(np.bincount(y, minlength=CLASSES))
        k, x1 = len(self.seen), np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))])
        t = np.searchsorted(self.seen, y)
        w = len(y) / (k * np.bincount(t)[t]) if self.balanced else np.ones(len(y))
        hot, d = np.eye(k)[t], x1.shape[1]
        ridge = np.tile(np.append(np.ones(d - 1), 1e-6), (k, 1))  # the intercept is hardly held

        def loss(b):
            z = x1 @ b.T
            top = z.max(1)
            return self.c * (w * (top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(t)), t])).sum() + 0.5 * (ridge * b * b).sum()

        b, now = np.zeros((k, d)), None
        for _ in range(50):
            p = softmax(x1 @ b.T)
            grad = self.c * ((p - hot) * w[:, None]).T @ x1 + ridge * b
            if np.abs(grad).max() < 1e-6 * max(1.0, self.c * len(y)):
                break
            hess = np.zeros((k, d, k, d))
            for i in range(k):
                for j in range(i, k):
                    h = self.c * (x1 * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x1
                    hess[i, :, j], hess[j, :, i] = h, h.T
            step = np.linalg.solve(hess.reshape(k * d, -1) + np.diag(ridge.ravel()), grad.ravel()).reshape(k, d)
            now, rate = loss(b) if now is None else now, 1.0
            while (new := loss(b - rate * step)) > now and rate > 1e-6:
                rate /= 2
            b, now = b - rate * step, new
        self.b = b
        return self

    def predict(self, x):
        out = np.zeros((len(x), CLASSES))
        out[:, self.seen] = softmax(np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))]) @ self.b.T)
        return out


class Binned:
    """Features as numbers of quantile bins of the slice; a split sends bins up to one of them left."""

    def __init__(self, x: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(self.edges) else np.zeros((len(x), 0), int)


@dataclass
class Tree:
    """Node i: rows with bin[feature] <= cut go to node left, others to left + 1; feature -1 is a leaf."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self, value) -> int:
        self.feature.append(-1)
        self.cut.append(0)
        self.left.append(0)
        self.value.append(value)
        return len(self.feature) - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, at = np.array(self.feature), np.array(self.cut), np.array(self.left), np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            at = np.where(inner, left[at] + (bins[rows, f] > cut[at]), at)
        return np.array(self.value)[at]


def grow(bins: np.ndarray, stats: np.ndarray, rows: np.ndarray, score, value, leaves: int, depth: int, least: float, columns) -> Tree:
    """The leaf whose split gains most is split next, until there are `leaves`.

    stats: for each row what score() and value() take summed over the rows of a node; the last one is the row's count.
    columns(): features that a split may use.
    """
    tree, heap, n = Tree(), [], 0

    def consider(node: int, at: np.ndarray, level: int, total: np.ndarray) -> None:
        nonlocal n
        if level >= depth or total[-1] < 2 * least:
            return
        cols = columns()
        flat = (bins[np.ix_(at, cols)] + np.arange(len(cols)) * BINS).ravel()
        left = np.stack([np.bincount(flat, np.repeat(s, len(cols)), len(cols) * BINS) for s in stats[at].T], -1).reshape(len(cols), BINS, -1).cumsum(1)
        right = total - left
        ok = (left[..., -1] >= least) & (right[..., -1] >= least)
        if not ok.any():
            return
        gain = np.where(ok, score(left) + score(right) - score(total), -np.inf)
        best = int(gain.argmax())
        if gain.flat[best] > 1e-12:
            n += 1
            f, b = divmod(best, BINS)
            heapq.heappush(heap, (-gain.flat[best], n, node, at, level, int(cols[f]), b))

    total = stats[rows].sum(0)
    consider(tree.add(value(total)), rows, 0, total)
    count = 1
    while heap and count < leaves:
        _, _, node, at, level, f, b = heapq.heappop(heap)
        low = bins[at, f] <= b
        tree.feature[node], tree.cut[node], tree.left[node] = f, b, len(tree.feature)
        count += 1
        sides = [(side, stats[side].sum(0)) for side in (at[low], at[~low])]
        new = [tree.add(value(s)) for _, s in sides]
        for k, (side, s) in zip(new, sides):
            consider(k, side, level + 1, s)
    return tree


@dataclass
class Forest:
    """Trees on bootstrap samples, by Gini gain over a random part of the features at each split; mean of the leaves' shares."""

    trees: int = 300
    depth: int = 5
    leaf: int = 20
    part: float = 0.5

    def fit(self, x, y, rng):
        self.binned = Binned(x)
        bins, hot, k = self.binned(x), np.eye(CLASSES)[y], max(1, int(self.part * x.shape[1]))
        gini = lambda s: (s[..., :CLASSES] ** 2).sum(-1) / np.maximum(s[..., :CLASSES].sum(-1), 1e-12)
        share = lambda s: s[:CLASSES] / max(s[:CLASSES].sum(), 1e-12)
        self.grown = []
        for _ in range(self.trees):
            drawn = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
            stats = np.hstack([hot * drawn[:, None], (drawn > 0)[:, None]])
            self.grown.append(
                grow(
                    bins, stats, np.flatnonzero(drawn), gini, share, 1 << self.depth, self.depth, self.leaf,
                    lambda: np.sort(rng.choice(x.shape[1], k, replace=False))
                )
            )
        return self

    def predict(self, x):
        bins = self.binned(x)
        return sum(t.predict(bins) for t in self.grown) / max(len(self.grown), 1)


@dataclass
class Boosted:
    """Softmax boosting, a tree for each class and round on gradients and curvatures, of a part of the rows and features.

    With `leaves` the best leaf grows first, whatever its depth; with `depth` alone all leaves of a level may split.
    """

    rounds: int = 300
    rate: float = 0.1
    leaves: int | None = None
    depth: int | None = None
    leaf: float = 20
    rows: float = 0.7
    part: float = 0.7
    ridge: float = 1.0

    def fit(self, x, y, rng):
        self.binned = Binned(x)
        bins, hot, n = self.binned(x), np.eye(CLASSES)[y], len(x)
        self.seen = np.flatnonzero(hot.sum(0))
        self.start = np.log(np.maximum(hot.mean(0), 1e-12))
        z, self.grown, k = np.tile(self.start, (n, 1)), [], max(1, round(self.part * x.shape[1]))
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.ridge)
        value = lambda s: -self.rate * s[0] / (s[1] + self.ridge)
        leaves, depth = self.leaves or 1 << self.depth, self.depth or 64
        for _ in range(self.rounds):
            p = softmax(z[:, self.seen])
            at = np.sort(rng.choice(n, max(1, round(self.rows * n)), replace=False))
            for i, c in enumerate(self.seen):
                cols = np.sort(rng.choice(x.shape[1], k, replace=False))
                stats = np.stack([p[:, i] - hot[:, c], np.maximum(p[:, i] * (1 - p[:, i]), 1e-12), np.ones(n)], 1)
                tree = grow(bins, stats, at, score, value, leaves, depth, self.leaf, lambda cols=cols: cols)
                self.grown.append((c, tree))
                z[:, c] += tree.predict(bins)
        return self

    def predict(self, x):
        bins, z = self.binned(x), np.tile(self.start, (len(x), 1))
        for c, tree in self.grown:
            z[:, c] += tree.predict(bins)
        out = np.zeros((len(x), CLASSES))
        out[:, self.seen] = softmax(z[:, self.seen])
        return out


def estimator(family: str, params: dict):
    """By the names of models.FAMILY_RANK; unknown ones raise."""
    p = dict(params)
    if family == "baseline":
        return Prior()
    if family == "logistic":
        return Logistic(p.get("C", 1.0), p.get("class_weight") == "balanced")
    if family == "forest":
        return Forest(p.get("trees", 300), p.get("depth", 5), p.get("leaf", 20))
    if family == "boosted":
        return Boosted(p.get("trees", 300), p.get("rate", 0.1), leaves=p.get("leaves", 15), leaf=p.get("leaf", 20))
    if family == "boosted_shallow":
        return Boosted(p.get("trees", 300), p.get("rate", 0.1), depth=p.get("depth", 3), leaf=1)
    raise ValueError(f"unknown model family {family!r}")


# ---------------------------------------------------------------- calibrators


def _scaled(q: np.ndarray) -> np.ndarray:
    total = q.sum(1, keepdims=True)
    return np.where(total > 0, q / np.where(total > 0, total, 1.0), 1 / CLASSES)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class SigmoidCurves:
    """One class against the rest: a logistic curve on the logit, its slope held by half its square; a class that is all or nothing passes through."""

    def fit(self, p: np.ndarray, y: np.ndarray):
        self.curves = {}
        for c in range(CLASSES):
            t = (y == c).astype(float)
            if 0 < t.sum() < len(t):
                x, b, ridge = np.stack([_logit(p[:, c]), np.ones(len(t))], 1), np.zeros(2), np.array([1.0, 0.0])
                loss = lambda b, x=x, t=t: (np.logaddexp(0, x @ b) - t * (x @ b)).sum() + 0.5 * b[0] ** 2
                for _ in range(100):
                    s = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
                    grad = x.T @ (s - t) + ridge * b
                    if np.abs(grad).max() < 1e-8 * len(t):
                        break
                    step, rate = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + np.diag(ridge + 1e-9), grad), 1.0
                    while loss(b - rate * step) > loss(b) and rate > 1e-6:
                        rate /= 2
                    b = b - rate * step
                self.curves[c] = b
        return self

    def transform(self, p: np.ndarray) -> np.ndarray:
        if not self.curves:
            return p
        return _scaled(
            np.stack(
                [1 / (1 + np.exp(-np.clip(self.curves[c][0] * _logit(p[:, c]) + self.curves[c][1], -500, 500))) if c in self.curves else np.clip(p[:, c], 1e-9, 1 - 1e-9) for c in range(CLASSES)],
                1
            )
        )


class IsotonicCurves:
    """One class against the rest: the rising steps closest to what was seen, straight lines between them, constant outside."""

    def fit(self, p: np.ndarray, y: np.ndarray):
        self.curves = {}
        for c in range(CLASSES):
            t = (y == c).astype(float)
            if 0 < t.sum() < len(t):
                xs, of = np.unique(p[:, c], return_inverse=True)
                blocks: list[list[float]] = []  # mean, weight, members
                for v, w in zip(np.bincount(of, t) / np.bincount(of), np.bincount(of)):
                    blocks.append([v, w, 1])
                    while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                        v2, w2, n2 = blocks.pop()
                        v1, w1, n1 = blocks.pop()
                        blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
                self.curves[c] = xs, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])
        return self

    def transform(self, p: np.ndarray) -> np.ndarray:
        if not self.curves:
            return p
        return _scaled(np.stack([np.interp(p[:, c], *self.curves[c]) if c in self.curves else p[:, c] for c in range(CLASSES)], 1))


CURVES = {"sigmoid": SigmoidCurves, "isotonic": IsotonicCurves}


def curves(name: str):
    if name not in CURVES:
        raise ValueError(f"unknown calibrator {name!r}; known: {sorted(CURVES)}")
    return CURVES[name]()


# ---------------------------------------------------------------- scores


def sharpe(x: np.ndarray) -> float:
    """Annualised; nan without variation or with fewer than two values."""
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / sd * np.sqrt(252)) if sd > 0 else float("nan")


def bootstrap_error(x: np.ndarray, replicates: int, block: float, seed: int) -> float:
    """Standard error of the Sharpe ratio over stationary bootstrap samples."""
    if len(x) < 2:
        return float("nan")
    rng, n = np.random.default_rng(seed), len(x)
    drawn = []
    for a in range(0, replicates, 256):
        k = min(256, replicates - a)
        restart = rng.random((k, n)) < 1 / block
        restart[:, 0] = True
        place = np.arange(n)
        at = np.maximum.accumulate(np.where(restart, place, 0), 1)
        start = np.take_along_axis(rng.integers(0, n, (k, n)), at, 1)
        s = x[(start + place - at) % n]
        sd = s.std(1, ddof=1)
        drawn.append(np.where(sd > 0, s.mean(1) / np.where(sd > 0, sd, 1) * np.sqrt(252), np.nan))
    return float(np.nanstd(np.concatenate(drawn), ddof=1)) if replicates > 1 else float("nan")


def brier(p: np.ndarray, y: np.ndarray) -> float:
    return float(((p - np.eye(CLASSES)[y]) ** 2).sum(1).mean()) if len(y) else float("nan")
