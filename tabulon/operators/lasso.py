"""Lasso path from cross-products.

One pass adds up, by fold, the cross-products of all features and the target.  Everything after it works on ``d x d``
matrices: the fit without a fold is the sum of the other folds' products, a fold's error is a quadratic form in its own.
Coordinate descent follows 100 penalties from the least one that zeroes every coefficient down to a thousandth of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Products:
    """Rows, sums and cross-products of (features..., target), taken about the whole table's means."""

    n: float
    s: np.ndarray
    g: np.ndarray

    def __add__(self, other: Products) -> Products:
        return Products(self.n + other.n, self.s + other.s, self.g + other.g)

    def centred(self) -> np.ndarray:
        return self.g - np.outer(self.s, self.s) / self.n


def products_by_fold(df: DataFrame, cols: Sequence[str], target: str, fold: Column) -> tuple[dict[int, Products], np.ndarray]:
    """Products of each fold, and the means of (features..., target).  Rows with a missing value are left out."""
    names = [*cols, target]
    rows = df.select(fold.cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"z{i}") for i, c in enumerate(names)])
    rows = rows.where(" AND ".join(f"z{i} IS NOT NULL AND NOT isnan(z{i})" for i in range(len(names))))
    got = rows.agg(*[F.avg(f"z{i}") for i in range(len(names))]).first()
    means = np.array([v or 0.0 for v in got])
    k = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], axis=1) - means
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            f = b.column(0).to_numpy(zero_copy_only=False)
            for one in np.unique(f):
                part = z[f == one]
                total[int(one)] = total.get(int(one), 0.0) + part.T @ part
        for one, m in total.items():
            at = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, one), pa.int32()), pa.array(at, pa.int32()), pa.array(m.ravel())], ["fold", "at", "v"])

    sums = rows.mapInArrow(add, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect()   # folds x (d + 2)^2 numbers
    whole = {r["fold"]: np.zeros((k + 1) ** 2) for r in sums}
    for r in sums:
        whole[r["fold"]][r["at"]] = r["v"]
    out = {f: m.reshape(k + 1, k + 1) for f, m in whole.items()}
    return {f: Products(m[0, 0], m[0, 1:], m[1:, 1:]) for f, m in out.items()}, means


def descend(p: Products, penalties: np.ndarray, tol: float = 1e-7, sweeps: int = 5000) -> np.ndarray:
    """Coefficients for falling penalties: minimisers of ``|y - Xw|^2 / 2n + penalty |w|_1``, each from the one before."""
    c = p.centred()
    d = len(c) - 1
    xx, xy = c[:d, :d], c[:d, d]
    scale = np.sqrt(np.diag(xx) / p.n)
    limit = tol * np.sqrt(max(c[d, d], 1e-300) / p.n)
    w, out = np.zeros(d), np.zeros((len(penalties), d))
    pull = xy.copy()   # xy - xx @ w
    for a, penalty in enumerate(penalties):
        for _ in range(sweeps):
            moved = 0.0
            for j in range(d):
                if scale[j] < 1e-12:
                    continue
                rho = pull[j] + xx[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - p.n * penalty, 0.0) / xx[j, j]
                if new != w[j]:
                    moved = max(moved, abs(new - w[j]) * scale[j])
                    pull -= xx[:, j] * (new - w[j])
                    w[j] = new
            if moved < limit:
                break
        out[a] = w
    return out


def error(p: Products, held: Products, w: np.ndarray) -> float:
    """Mean squared error on held-out rows of a fit with intercept on the rows of ``p``."""
    u = np.append(-w, 1.0)
    b = u @ p.s / p.n
    return float((u @ held.g @ u - 2 * b * (u @ held.s) + held.n * b * b) / held.n)


def lasso_path(df: DataFrame, cols: Sequence[str], target: str, fold: Column, steps: int = 100, least: float = 1e-3) -> dict:
    """``penalties``, mean held-out ``errors``, ``best`` penalty, and ``coefficients`` on all rows at it."""
    parts, _ = products_by_fold(df, cols, target, fold)
    d = len(cols)
    if not parts:
        return {"penalties": np.zeros(0), "errors": np.zeros(0), "best": 0.0, "coefficients": np.zeros(d)}
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    most = np.abs(whole.centred()[:d, d]).max() / whole.n
    if most <= 0:
        return {"penalties": np.zeros(1), "errors": np.zeros(1), "best": 0.0, "coefficients": np.zeros(d)}
    penalties = most * np.logspace(0, np.log10(least), steps)
    errors = []
    for f, held in sorted(parts.items()):
        others = [p for g, p in parts.items() if g != f]
        if not others:
            continue
        rest = sum(others[1:], others[0])
        errors.append([error(rest, held, w) for w in descend(rest, penalties)])
    mean = np.mean(errors, axis=0) if errors else np.zeros(steps)
    at = int(np.argmin(mean))
    return {"penalties": penalties, "errors": mean, "best": float(penalties[at]), "coefficients": descend(whole, penalties[:at + 1])[-1]}
