"""Linear SVMs on random Fourier features, several fits in shared passes.

Spark's ``LinearSVC`` keeps every row's mapped numbers, 1.6 kB at 200 components, and passes over them two or three times an
iteration and fit.  Here rows stay as their few features, in packed blocks; a pass maps them again and adds up loss and gradient
of every fit, at every step that its line search may ask for next.  Objective, optimiser (orthant-wise quasi-Newton without an L1
part), line search and stopping rules are those of ``LinearSVC``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut_lineage

#: Rows to a packed block, and rows that are mapped at once (their numbers fit the processor's cache).
_BLOCK, _MAPPED = 50_000, 192
#: cos(2 pi sqrt(u)) for u in [0, 1/4] as a polynomial, to 4e-15.
_U = np.cos(np.linspace(0, np.pi, 400)) * 0.125 + 0.125
_COS = np.polynomial.polynomial.polyfit(_U, np.cos(2 * np.pi * np.sqrt(_U)), 11)


def cosine(x: np.ndarray) -> np.ndarray:
    """``np.cos`` in whole-array steps; changes ``x``."""
    x *= 1 / (2 * np.pi)
    x -= np.rint(x)
    x *= x
    out = np.full_like(x, _COS[-1])
    for c in _COS[-2::-1]:
        out *= x
        out += c
    return out


def packed(df: DataFrame, features: str, fold: Column) -> DataFrame:
    """``n, x, y, fold``: blocks of rows, materialised.  Labels other than 0 and 1 and features that are not finite are an
    error."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(held: list) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column(0).combine_chunks()
            x, y = lists.flatten().to_numpy(zero_copy_only=False).astype(float), t.column(1).to_numpy().astype(float)
            if not np.isin(y, (0.0, 1.0)).all() or not np.isfinite(x).all():
                raise ValueError("labels must be 0 or 1 and features must be finite")
            parts = [x.tobytes(), y.astype(np.int8).tobytes(), t.column(2).to_numpy().astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["n", "x", "y", "fold"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _BLOCK:
                yield record(held)
                held, n = [], 0
        if n:
            yield record(held)

    rows = df.select(vector_to_array(features).alias("x"), F.col("label").cast("double").alias("y"), fold.cast("int").alias("fold"))
    return cut_lineage(rows.mapInArrow(pack, "n int, x binary, y binary, fold binary"))


def _mapped(b: pa.RecordBatch, w: np.ndarray, shift: np.ndarray) -> Iterator[tuple]:
    """Mapped numbers, signs and folds of some rows at a time."""
    scale = math.sqrt(2.0 / len(shift))
    for n, x, y, fold in zip(*(b.column(c).to_pylist() for c in ("n", "x", "y", "fold")), strict=True):
        x, sign, fold = np.frombuffer(x).reshape(n, -1), 2.0 * np.frombuffer(y, np.int8) - 1.0, np.frombuffer(fold, np.int32)
        for at in range(0, n, _MAPPED):
            z = x[at:at + _MAPPED] @ w.T
            z += shift
            z = cosine(z)
            z *= scale
            yield z, sign[at:at + _MAPPED], fold[at:at + _MAPPED]


def moments(rows: DataFrame, w: np.ndarray, shift: np.ndarray) -> dict[int, tuple]:
    """Rows, sums, sums of squares, least and greatest values of the mapped columns in each fold."""
    d = len(shift)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for z, _, fold in _mapped(b, w, shift):
                for k in np.unique(fold):
                    p = z[fold == k]
                    new = np.concatenate([[len(p)], p.sum(0), (p * p).sum(0), p.min(0), p.max(0)])
                    held[int(k)] = new if int(k) not in held else _together(held[int(k)], new, d)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["fold", "v"])

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(add, "fold int, v binary").collect():
        v = np.frombuffer(bytes(r["v"]))
        out[r["fold"]] = v if r["fold"] not in out else _together(out[r["fold"]], v, d)
    return out


def _together(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    n = 2 * d + 1
    return np.concatenate([a[:n] + b[:n], np.minimum(a[n:n + d], b[n:n + d]), np.maximum(a[n + d:], b[n + d:])])


def _losses(rows: DataFrame, w: np.ndarray, shift: np.ndarray, coef: np.ndarray, offset: np.ndarray, without: np.ndarray) -> tuple:
    """Hinge losses of some linear functions (columns of ``coef``), sums of their multipliers, and of multipliers times mapped
    numbers; each leaves out the rows of a fold (-1: none)."""
    d, q = coef.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 2, q))
        for b in batches:
            for z, sign, fold in _mapped(b, w, shift):
                left = 1.0 - sign[:, None] * (z @ coef + offset)
                on = (left > 0) & (fold[:, None] != without)
                pull = np.where(on, -sign[:, None], 0.0)
                total[0] += np.where(on, left, 0.0).sum(0)
                total[1] += pull.sum(0)
                total[2:] += z.T @ pull
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = sum((np.frombuffer(bytes(r["v"])).reshape(d + 2, q) for r in rows.mapInArrow(add, "v binary").collect()), np.zeros((d + 2, q)))
    return total[0], total[1], total[2:]


def minimise(start: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Iterator:
    """Breeze's OWLQN without an L1 part, as a generator: it asks for (value, gradient) at points, the first of which it needs
    and the others it may need next, and returns the last point."""
    x = start
    (value, grad), *_ = yield [x]
    first, history, seen, failed = value, [], [math.inf], False
    for k in range(max_iter + 1):
        flat = len(seen) > 1 and abs(value - max(seen)) <= tol * first
        if k >= max_iter or flat or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            direction = _direction(grad, history)
            orthant = np.where(x != 0, np.sign(x), np.sign(-grad))
            step = lambda a, x=x, o=orthant, d=direction: np.where(np.sign(x + d * a) == o, x + d * a, 0.0)
            shrink, alpha = (0.1, 0.5 / np.linalg.norm(grad)) if k < 1 else (0.5, 1.0)
            slope, at, known = grad @ direction, (value, None), {}
            for turn in range(20):
                if at[0] > value + alpha * slope * 1e-4:
                    by = shrink
                else:
                    if at[1] is None:
                        known[alpha], *_ = yield [step(alpha)]
                        at = known[alpha][0], known[alpha][1] @ direction
                    by = 2.1 if at[1] < 0.9 * slope else shrink if at[1] > -0.9 * slope else 1.0
                if by == 1.0 or turn == 19:
                    break
                if not 1e-10 <= alpha * by <= 1e10:
                    raise ArithmeticError("step size")
                alpha *= by
                if alpha not in known:
                    ahead = [alpha, alpha * 2.1, alpha * shrink]
                    known |= dict(zip(ahead, (yield [step(a) for a in ahead]), strict=True))
                at = known[alpha][0], known[alpha][1] @ direction
            new = step(alpha)
            if alpha not in known:
                known[alpha], *_ = yield [new]
            new_value, new_grad = known[alpha]
        except ArithmeticError:
            if failed:
                break
            history, failed = [], True
            continue
        failed = False
        history = [(new - x, new_grad - grad), *history][:memory]
        x, value, grad = new, new_value, new_grad
        seen = [*seen, value][-20:]
    return x


def _direction(grad: np.ndarray, history: list) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of the gradient, nowhere against the gradient's sign."""
    out, scale, turns = grad.copy(), 1.0, []
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise ArithmeticError("curvature")
        scale = (s @ y) / (y @ y)
    for s, y in history:
        rho = s @ y
        a = (s @ out) / rho if rho else math.nan
        if math.isnan(a):
            raise ArithmeticError("curvature")
        out -= a * y
        turns.append((a, rho))
    out *= scale
    for (s, y), (a, rho) in zip(reversed(history), reversed(turns), strict=True):
        out += (a - (y @ out) / rho) * s
    out *= -1.0
    return np.where(out * grad < 0, out, 0.0)


def fit_folds(rows: DataFrame, w: np.ndarray, shift: np.ndarray, without: Sequence[int], penalty: float, max_iter: int = 100, tol: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept of a linear SVM without each of some folds (-1: on all rows), fitted side by side."""
    d, stats = len(shift), moments(rows, w, shift)
    scaled = []
    for k in without:
        own = [v for f, v in stats.items() if f != k]
        if not own:
            raise ValueError("no rows to fit")
        m = own[0]
        for v in own[1:]:
            m = _together(m, v, d)
        n, mean = m[0], m[1:d + 1] / m[0]
        var = np.maximum(m[d + 1:2 * d + 1] - n * mean * mean, 0.0) / max(n - 1, 1)
        sd = np.where(m[2 * d + 1:3 * d + 1] < m[3 * d + 1:], np.sqrt(var), 0.0)
        inverse = np.divide(1.0, sd, out=np.zeros(d), where=sd > 0)
        scaled.append((n, inverse, mean * inverse))
    fits = [minimise(np.zeros(d + 1), max_iter, tol) for _ in without]
    asked, found = {i: next(f) for i, f in enumerate(fits)}, {}
    while asked:
        points = [(i, p) for i, ps in asked.items() for p in ps]
        coef = np.stack([p[:d] * scaled[i][1] for i, p in points], axis=1)
        offset = np.array([p[d] - p[:d] @ scaled[i][2] for i, p in points])
        loss, pull, pulled = _losses(rows, w, shift, coef, offset, np.array([without[i] for i, _ in points]))
        got: dict[int, list] = {}
        for at, (i, p) in enumerate(points):
            n, inverse, mean = scaled[i]
            grad = np.append((pulled[:, at] * inverse - pull[at] * mean) / n + penalty * p[:d], pull[at] / n)
            got.setdefault(i, []).append((loss[at] / n + 0.5 * penalty * p[:d] @ p[:d], grad))
        for i, values in got.items():
            try:
                asked[i] = fits[i].send(values)
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
    return [(found[i][:d] * scaled[i][1], float(found[i][d] - found[i][:d] @ scaled[i][2])) for i in range(len(without))]


def margins(rows: DataFrame, w: np.ndarray, shift: np.ndarray, models: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """``margin, label`` of every row by the model of its fold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = [(sum(np.where(fold == k, z @ c + a, 0.0) for k, (c, a) in models.items()), sign) for z, sign, fold in _mapped(b.slice(i, 1), w, shift)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m for m, _ in parts])), pa.array((np.concatenate([s for _, s in parts]) + 1) / 2)], ["margin", "label"])

    return rows.mapInArrow(score, "margin double, label double")
