"""Model-based search of forest settings: a Gaussian-process surrogate with expected improvement.

Every round proposes a few points, and all of their folds' forests are grown together on the whole training table.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from tabulon.operators import forest as FO

# The ranges of the search.
RANGES = {"trees": (50, 200), "depth": (3, 20), "min_split": (2, 20), "min_leaf": (1, 10)}
SUBSETS = ("sqrt", "log2", None)


def draw(rng: np.random.Generator, n: int) -> list[tuple]:
    """Random points: one whole number a range, then a feature subset."""
    return [(*(int(rng.integers(lo, hi + 1)) for lo, hi in RANGES.values()), SUBSETS[rng.integers(len(SUBSETS))]) for _ in range(n)]


def encode(points: list[tuple]) -> np.ndarray:
    """Points in the unit cube, a subset as one place of three."""
    out = [[(p[i] - lo) / (hi - lo) for i, (lo, hi) in enumerate(RANGES.values())] + [float(p[-1] == s) for s in SUBSETS] for p in points]
    return np.array(out).reshape(len(points), len(RANGES) + len(SUBSETS))


def surrogate(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at ``at`` of a Gaussian process through (x, y): squared-exponential kernel, the length scale and
    noise of greatest likelihood on a small grid."""
    mean, sd = y.mean(), max(y.std(), 1e-9)
    z = (y - mean) / sd
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    best = None
    for scale in (0.3, 0.6, 1.0, 2.0):
        for noise in (1e-4, 1e-2, 1e-1):
            k = np.exp(-far / (2 * scale**2)) + noise * np.eye(len(x))
            lower = np.linalg.cholesky(k)
            a = np.linalg.solve(lower.T, np.linalg.solve(lower, z))
            fit = -0.5 * z @ a - np.log(np.diag(lower)).sum()
            if best is None or fit > best[0]:
                best = (fit, scale, noise, lower, a)
    _, scale, noise, lower, a = best
    near = np.exp(-((at[:, None] - x[None]) ** 2).sum(axis=2) / (2 * scale**2))
    v = np.linalg.solve(lower, near.T)
    return mean + sd * near @ a, sd * np.sqrt(np.maximum(1 + noise - (v**2).sum(axis=0), 1e-12))


def improvement(mean: np.ndarray, dev: np.ndarray, best: float) -> np.ndarray:
    """Expected gain over ``best`` of a normal value."""
    z = (mean - best) / dev
    density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    return (mean - best) * below + dev * density


def propose(tried: list[tuple], scores: list[float], n: int, rng: np.random.Generator, pool: int = 1000) -> list[tuple]:
    """The next ``n`` points: greatest expected improvement one by one, each taken to score what the surrogate expects."""
    points, y, out = list(tried), list(scores), []
    for _ in range(n):
        seen = set(points)
        rest = [p for p in draw(rng, pool) if p not in seen]
        x = encode(rest)
        mean, dev = surrogate(encode(points), np.array(y), x)
        at = int(np.argmax(improvement(mean, dev, max(y))))
        out.append(rest[at])
        points.append(rest[at])
        y.append(float(mean[at]))
    return out


def spec_of(point: tuple, seed: int) -> FO.ForestSpec:
    return FO.ForestSpec(trees=point[0], depth=point[1], min_split=point[2], min_leaf=point[3], max_features=point[4], seed=seed)


def search_forest(rows: DataFrame, d: int, folds: int = 3, fits: int = 30, first: int = 10, batch: int = 5, seed: int = 42) -> tuple[list[dict], FO.ForestSpec]:
    """Search on ``forest.binned_rows`` with a fold column: all tried points with their mean and fold accuracies, and the
    best point's spec (the first of equals).  All rows take part in every fit and every score."""
    rng = np.random.default_rng(seed)
    rows = FO.in_blocks(rows, d)   # once for all rounds
    tried: list[tuple] = []
    scores: list[float] = []
    out: list[dict] = []
    while len(tried) < fits:
        n = min(fits - len(tried), batch if tried else first)
        if tried:
            points = propose(tried, scores, n, rng)
        else:
            points = list(dict.fromkeys(draw(rng, 4 * n)))[:n]
        specs = [replace(spec_of(p, seed), without_fold=k) for p in points for k in range(folds)]
        by_fit = FO.held_out_accuracy(rows, FO.grow_and_score(rows, specs, d)[1], specs, d)
        for i, p in enumerate(points):
            folds_of = [by_fit[i * folds + k] for k in range(folds)]
            tried.append(p)
            scores.append(float(np.mean(folds_of)))
            out.append({"point": p, "score": scores[-1], "folds": folds_of, "model_based": len(tried) > first})
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return out, spec_of(tried[best], seed)
