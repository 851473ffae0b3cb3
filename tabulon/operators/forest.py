"""Many forests grown together.

``grow_forests`` fits any number of forests (folds, grid points, members) on one table in shared passes:

1. Features are cut into at most ``BINS`` bins at quantiles of the table; a row becomes ``d`` bytes.  No split can part
   rows of equal bytes, so rows are dealt by them and a tree sees such a cell once, with the sums of its rows' draws.
   ``packed_rows`` keeps whole blocks of cells with little more than their rows' keys.
2. While nodes hold more than ``local_rows`` cells, all trees of all forests grow by one level a pass: every task adds up
   counts by (tree, node, feature, bin, class), one grouped aggregate merges them, and the best split of each node is found
   where its counts meet.  Only splits, one row a node, reach the driver.
3. The cells of every smaller node are brought together once, packed, and one task grows the whole subtree below it, level by
   level over all its nodes at once, without a limit on depth unless one is set.  Where the table itself is that small, its
   cells are broadcast and only the draws are brought together, once for all forests that share them.

Both parts choose the same splits: candidate features, random thresholds and bootstrap weights are hashes of seed, tree,
node path and row key, so the forest does not depend on partitions or on ``local_rows``.  A tree is a row of four arrays.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.fitted import TableModel
from tabulon.session import by_key, cut_lineage, shuffle_partitions

BINS = 128
#: Cells (rows of equal bins) of a node that one task may hold; each takes ``d + 8`` bytes packed, some 150 while it grows.
LOCAL_ROWS = 1_000_000
#: Bytes of trees that are broadcast at once for scoring.
MODEL_BYTES = 64 << 20
#: Rows that a task packs at once.
_PACK = 1_000_000
#: Rows that are hashed at once, few enough for the processor's cache.
_HASHED = 1 << 15
#: Shares of a partition that rows are dealt to: a block holds whole ones, so that no cell lies in two.
_SHARES = 8
#: Cells that a level's counts may take as plain arrays; beyond it only occupied cells are counted.
_DENSE = 1 << 22
#: Poisson(1) distribution function: how often a row is drawn for a tree.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: The draw by the 12 leading bits of the hash, 255 where a step of the distribution function lies among the rest.
_DRAWN = np.searchsorted(_POISSON, np.arange(4096) / 4096, side="right").astype(np.uint8)
_DRAWN[np.searchsorted(_POISSON, (np.arange(4096) + 1) / 4096, side="right") != _DRAWN] = 255
_TREES = "fit int, tree int, feature binary, cut binary, child binary, value binary, gain array<double>"


@dataclass(frozen=True)
class ForestSpec:
    """One forest: ``depth`` None grows until leaves are pure; ``extra`` draws one random threshold a feature instead of
    searching the best; ``without_fold`` leaves that fold's rows out; ``features`` are the places of the columns it may use
    (its trees number them from 0)."""

    trees: int = 100
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    max_features: str | None = "sqrt"
    extra: bool = False
    bootstrap: bool = True
    seed: int = 42
    without_fold: int | None = None
    features: tuple[int, ...] | None = None

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The columns that this forest sees (``features``, or all)."""
        return x if self.features is None else x[:, list(self.features)]

    def width(self, d: int) -> int:
        return d if self.features is None else len(self.features)

    def candidates(self, d: int) -> int:
        return {"sqrt": max(1, int(math.sqrt(d))), "log2": max(1, int(math.log2(d))), None: d}[self.max_features]


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: well spread hashes of whole numbers."""
    with np.errstate(over="ignore"):
        x = (np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _root(spec: ForestSpec, tree: int) -> np.uint64:
    return _mix(_mix(np.uint64(spec.seed)) ^ np.uint64(tree))


def _weights(spec: ForestSpec, tree: int, keys: np.ndarray) -> np.ndarray:
    if not spec.bootstrap:
        return np.ones(len(keys), np.uint8)
    out, root = np.empty(len(keys), np.uint8), _root(spec, tree)
    for at in range(0, len(keys), _HASHED):
        h = _mix(keys[at:at + _HASHED].astype(np.uint64) ^ root)
        part = _DRAWN[(h >> np.uint64(52)).astype(np.int64)]
        near = np.flatnonzero(part == 255)   # the leading bits leave the draw open
        part[near] = np.searchsorted(_POISSON, _unit(h[near]), side="right")
        out[at:at + _HASHED] = part
    return out


def _children(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return _mix(path * np.uint64(2) + np.uint64(1)), _mix(path * np.uint64(2) + np.uint64(2))


def _order(path: np.ndarray, d: int) -> np.ndarray:
    """A random order of the features for each node."""
    return np.argsort(_mix(path[:, None] ^ _mix(np.arange(1, d + 1, dtype=np.uint64))[None, :]), axis=1)


def _best(node, slot, bin_, w, wy, total, total_y, path, cand, spec):
    """Best split of each node from its occupied cells, sorted by (node, slot, bin): slot, cut and left counts, or slot -1.

    The score of a cut is what the Gini impurity leaves of the sums of squares; ties go to the first slot and bin."""
    k = len(total)
    out_slot, out_cut, out_w, out_y = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    if not len(node):
        return out_slot, out_cut, out_w, out_y
    segment = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (slot[1:] != slot[:-1])))
    length = np.diff(np.append(segment, len(node)))
    before_w, before_y = np.cumsum(w) - w, np.cumsum(wy) - wy
    left = np.cumsum(w) - np.repeat(before_w[segment], length)
    left_y = np.cumsum(wy) - np.repeat(before_y[segment], length)
    last = np.zeros(len(node), bool)
    last[segment + length - 1] = True
    cut = bin_.astype(np.int64)
    right, right_y = total[node] - left, total_y[node] - left_y
    ok = ~last & (left >= spec.min_leaf) & (right >= spec.min_leaf)
    if spec.extra:
        low, high = bin_[segment].astype(np.int64), bin_[segment + length - 1].astype(np.int64)
        u = _unit(_mix(path[node[segment]] ^ _mix(np.uint64(1) << np.uint64(40) | cand[node[segment], slot[segment]].astype(np.uint64))))
        drawn = np.repeat(low + np.floor(u * (high - low)).astype(np.int64), length)
        after = np.append(cut[1:], 0)
        ok &= (cut <= drawn) & (after > drawn)
        cut = drawn
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left_y**2 + (left - left_y)**2) / left + (right_y**2 + (right - right_y)**2) / right
    score = np.where(ok, score, -1.0)
    top = np.full(k, -1.0)
    np.maximum.at(top, node, score)
    at = np.flatnonzero(ok & (score == top[node]))
    first = at[np.unique(node[at], return_index=True)[1]] if len(at) else at
    which = node[first]
    out_slot[which], out_cut[which], out_w[which], out_y[which] = slot[first], cut[first], left[first], left_y[first]
    return out_slot, out_cut, out_w, out_y


def _score(left, left_y, total, total_y):
    """What the Gini impurity leaves of the sums of squares, from the left side's counts and the node's."""
    right, right_y = total - left, total_y - left_y
    with np.errstate(divide="ignore", invalid="ignore"):
        return (left_y**2 + (left - left_y)**2) / left + (right_y**2 + (right - right_y)**2) / right


class _Pair:
    """Weights of all rows and of those of label 1, in one whole number each where their sums fit: added up and moved at once."""

    def __init__(self, weight: np.ndarray, hit: np.ndarray, slots: int):
        weight, hit = weight.astype(np.int64), hit.astype(np.int64)
        self.bits = max(1, int(hit.sum()).bit_length())
        most = int(weight.sum()) << self.bits
        one = most * max(slots, 1) < 1 << 62 and (hit >= 0).all()
        #: exact in a double
        self.small = one and most < 1 << 53
        self.parts = [(weight << self.bits) | hit] if one else [weight, hit]

    def map(self, f) -> list:
        return [f(p) for p in self.parts]

    def apart(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Both sums, as doubles."""
        if len(parts) == 2:
            return parts[0].astype(float), parts[1].astype(float)
        return (parts[0] >> self.bits).astype(float), (parts[0] & ((1 << self.bits) - 1)).astype(float)

    def bincount(self, code: np.ndarray, parts: list, slots: int, space: int) -> tuple[np.ndarray, list]:
        """Occupied codes of cells that come ``slots`` times, and their sums."""
        if len(parts) == 1 and not self.small:   # a sum of both has more digits than a double
            parts = list(self.apart(parts))
        sums = [np.bincount(code, np.tile(p.astype(float), slots), space) for p in parts]
        met = np.flatnonzero(sums[0])
        out = [v[met].astype(np.int64) for v in sums]
        return met, out if len(out) == len(self.parts) else [(out[0] << self.bits) | out[1]]


def _drawn_cuts(bins, pair, parts, start, near, total, total_y, path, spec):
    """As ``_best_cuts``, at one random cut between a feature's least and greatest bin in the node."""
    k, m = near.shape
    size = np.diff(start)
    top, out = np.full(k, -1.0), (np.full(k, -1), np.zeros(k, np.int64), np.zeros(k), np.zeros(k))
    for s in range(m):
        low, high = (f.reduceat(bins[s], start[:-1]).astype(np.int64) for f in (np.minimum, np.maximum))
        u = _unit(_mix(path ^ _mix(np.uint64(1) << np.uint64(40) | near[:, s].astype(np.uint64))))
        cut = low + np.floor(u * (high - low)).astype(np.int64)
        below = bins[s] <= np.repeat(cut.astype(bins[s].dtype), size)
        left, left_y = pair.apart([np.add.reduceat(np.where(below, p, 0), start[:-1]) for p in parts])
        ok = (low < high) & (left >= spec.min_leaf) & (total - left >= spec.min_leaf)
        at = np.flatnonzero(ok)
        score = _score(left[at], left_y[at], total[at], total_y[at])
        at, score = at[score > top[at]], score[score > top[at]]
        top[at] = score
        for o, v in zip(out, (np.full(k, s), cut, left, left_y), strict=True):
            o[at] = v[at]
    return out


def _best_cuts(bins, pair, parts, start, near, total, total_y, spec, stride):
    """Best cut of every node from its cells, which lie from ``start`` on: slot of its feature (-1: none), cut and left counts.
    ``bins`` are the cells' bins in each slot, below ``stride``; ties go to the first slot and bin."""
    k, m = near.shape
    out = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    n = start[-1]
    base = np.repeat(np.arange(k, dtype=np.int64) * (m * stride), np.diff(start))
    code = np.concatenate([base + (s * stride) + bins[s] for s in range(m)])
    if (space := k * m * stride) <= min(_DENSE, 6 * len(code)):
        code, got = pair.bincount(code, parts, m, space)
        upto = [np.cumsum(g) for g in got]
        before = [u - g for u, g in zip(upto, got, strict=True)]
    else:   # deep levels: many nodes, few cells in each
        bits = max(int(n - 1).bit_length(), 1)
        code = (code << bits) | np.tile(np.arange(n, dtype=np.int64), m)
        code.sort()
        row, code = code & ((1 << bits) - 1), code >> bits
        last = np.flatnonzero(np.append(code[1:] != code[:-1], True))
        code, upto = code[last], [np.cumsum(p[row])[last] for p in parts]
        before = [np.append(0, u[:-1]) for u in upto]
    segment = code // stride
    new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    length = np.diff(np.append(new, len(code)))
    left, left_y = pair.apart([u - np.repeat(b[new], length) for u, b in zip(upto, before, strict=True)])
    node = segment // m
    w = total[node]
    score = _score(left, left_y, w, total_y[node])
    ok = (left >= spec.min_leaf) & (w - left >= spec.min_leaf)
    ok[new + length - 1] = False
    score[~ok] = -1.0
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))   # every node has cells
    top = np.maximum.reduceat(score, first)
    at = np.flatnonzero(ok & (score == np.repeat(top, np.diff(np.append(first, len(node))))))
    at = at[np.append(True, node[at[1:]] != node[at[:-1]])] if len(at) else at
    which = node[at]
    out[0][which], out[1][which], out[2][which], out[3][which] = segment[at] % m, code[at] % stride, left[at], left_y[at]
    return out


def _open(total, total_y, depth, spec):
    return (total >= spec.min_split) & (total_y > 0) & (total_y < total) & (spec.depth is None or depth < spec.depth)


def _gain(total, total_y, lw, ly):
    """Weighted decrease of the Gini impurity."""
    gini = lambda n, y: 2 * y * (n - y) / np.maximum(n, 1e-300)
    return gini(total, total_y) - gini(lw, ly) - gini(total - lw, total_y - ly)


def grow_subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: np.uint64, depth: int, spec: ForestSpec) -> dict:
    """The tree below one node from its rows (bins, label, weight), see ``grow_cells``."""
    return grow_cells(x, w.astype(float), w.astype(float) * y, path, depth, spec)


def grow_cells(x: np.ndarray, weight: np.ndarray, hit: np.ndarray, path: np.uint64, depth: int, spec: ForestSpec) -> dict:
    """The tree below one node from its cells (bins, weight, weight of label 1): arrays of feature (-1: leaf), cut, first child
    (the second follows it) and share of label 1, and the impurity decrease by feature.  All nodes of a level are split at
    once; cells lie in the order of their nodes, their bins in whole words."""
    d = x.shape[1]
    wide = -(-max(d, 1) // 8) * 8
    words = np.zeros((len(x), wide), np.uint8)
    words[:, :d] = x
    words = words.view(np.uint64)[:, 0].copy() if wide == 8 else words.view(np.uint64)
    stride, m = int(x.max()) + 1 if x.size else 1, spec.candidates(d)
    pair = _Pair(weight, hit, d)
    parts = pair.parts
    feature, cut, child, value = [[-1]], [[0]], [[-1]], [[hit.sum() / max(weight.sum(), 1e-300)]]
    gain = np.zeros(d)
    paths, made, start = np.array([path], np.uint64), 1, np.array([0, len(x)])
    total, total_y = np.array([float(weight.sum())]), np.array([float(hit.sum())])
    level_at, depth_now = 0, depth
    while True:
        # a node of one cell has no cut
        size = np.diff(start)
        wanted = _open(total, total_y, depth_now, spec) & (size > 1)
        sub = np.flatnonzero(wanted)
        if not len(sub):
            break
        if len(sub) < len(paths):
            keep = np.flatnonzero(np.repeat(wanted, size))
            words, parts, size = words[keep], [p[keep] for p in parts], size[sub]
            total, total_y, paths, start = total[sub], total_y[sub], paths[sub], np.append(0, np.cumsum(size))
        k, flat, row = len(sub), words.view(np.uint8).ravel(), np.arange(0, wide * len(words), wide)
        order = _order(paths, d)
        f, c, lw, ly = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        todo = np.arange(k)
        for slots in (slice(0, m), slice(m, d)):   # where no candidate parts a node, the other features get their turn
            near = order[todo, slots]
            if not near.size:
                break
            some, own, at = size[todo], parts, row
            if len(todo) < k:
                mine = np.zeros(k, bool)
                mine[todo] = True
                rows = np.flatnonzero(np.repeat(mine, size))
                own, at = [p[rows] for p in parts], row[rows]
            begin = np.append(0, np.cumsum(some))
            bins = [flat[at + np.repeat(near[:, s], some)] for s in range(near.shape[1])]
            slot, best, a, y = (_drawn_cuts(bins, pair, own, begin, near, total[todo], total_y[todo], paths[todo], spec) if spec.extra
                                else _best_cuts(bins, pair, own, begin, near, total[todo], total_y[todo], spec, stride))
            got = np.flatnonzero(slot >= 0)
            where = todo[got]
            f[where], c[where], lw[where], ly[where] = near[got, slot[got]], best[got], a[got], y[got]
            todo = todo[slot < 0]
        done = np.flatnonzero(f >= 0)
        if not len(done):
            break
        np.add.at(gain, f[done], _gain(total, total_y, lw, ly)[done])
        at = sub[done]   # places in the level
        feature[level_at], cut[level_at], child[level_at] = (np.array(v[level_at]) for v in (feature, cut, child))
        feature[level_at][at], cut[level_at][at], child[level_at][at] = f[done], c[done], made + 2 * np.arange(len(at))
        if len(done) < k:
            keep = np.flatnonzero(np.repeat(f >= 0, size))
            words, parts, size = words[keep], [p[keep] for p in parts], size[done]
            total, total_y, paths, lw, ly, f, c = (v[done] for v in (total, total_y, paths, lw, ly, f, c))
            start, flat, row = np.append(0, np.cumsum(size)), words.view(np.uint8).ravel(), row[:len(words)]
        right = flat[row + np.repeat(f, size)] > np.repeat(c, size)
        upto = np.cumsum(right)
        right_n = np.diff(np.append(0, upto[start[1:] - 1]))
        before = upto - right - np.repeat(np.cumsum(right_n) - right_n, size)   # cells of the node that go right, up to this one
        place = np.where(right, np.repeat(start[1:] - right_n, size) + before, np.arange(len(right)) - before)
        moved = [np.empty_like(v) for v in (words, *parts)]
        for v, old in zip(moved, (words, *parts), strict=True):
            v[place] = old
        words, *parts = moved
        beside = lambda a, b: np.stack([a, b], axis=1).ravel()
        start = np.append(0, np.cumsum(beside(size - right_n, right_n)))
        paths = beside(*_children(paths))
        total, total_y = beside(lw, total - lw), beside(ly, total_y - ly)
        feature.append(np.full(len(paths), -1))
        cut.append(np.zeros(len(paths), np.int64))
        child.append(np.full(len(paths), -1))
        value.append(total_y / np.maximum(total, 1e-300))
        made += len(paths)
        level_at, depth_now = level_at + 1, depth_now + 1
    return {"feature": np.concatenate(feature).astype(np.int16), "cut": np.concatenate(cut).astype(np.uint8),
            "child": np.concatenate(child).astype(np.int32), "value": np.concatenate(value).astype(np.float32), "gain": gain}


def _walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Place of each row's leaf in a tree's arrays."""
    feature, cut, child = tree[:3]
    out, rows, at = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(rows):
        f = feature[at]
        if (ended := f < 0).any():
            out[rows[ended]] = at[ended]
            rows, at, f = rows[~ended], at[~ended], f[~ended]
        at = child[at] + (x[rows, f] > cut[at])
    return out


# ---------------------------------------------------------------- binned rows
def feature_edges(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` cut values of each column, from one aggregate of mergeable sketches."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 10_000).alias(f"e{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [sorted({float(v) for v in row[f"e{i}"] or [] if v is not None and v < row[f"m{i}"]}) for i in range(len(cols))]


def _binned(batches: Iterator[pa.RecordBatch], cuts: list) -> Iterator[tuple]:
    """Keys, folds, labels and bins of some ``_PACK`` rows at a time; a fold that is missing is one that no forest leaves out."""

    def arrays(held: list) -> tuple:
        t = pa.Table.from_batches(held)
        x = np.stack([np.searchsorted(c, t.column(3 + i).to_numpy(), side="left") for i, c in enumerate(cuts)], axis=1)
        return t.column(0).fill_null(-1 << 63).to_numpy(), t.column(1).fill_null(-1).to_numpy(), t.column(2).to_numpy(), np.ascontiguousarray(x.astype(np.uint8))

    held: list = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= _PACK:
            yield arrays(held)
            held = []
    if held:
        yield arrays(held)


def _fixed(x: np.ndarray) -> pa.FixedSizeBinaryArray:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])


def _cell_hash(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, :x.shape[1]] = x
    h = np.zeros(len(x), np.uint64)
    for word in wide.view(np.uint64).T:
        h = _mix(h ^ word)
    return h


def _raw(df: DataFrame, cols: Sequence[str], label: str, key: str, fold: str | None) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                     F.col(f"`{label}`").cast("int").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return rows.where("y IS NOT NULL")


def binned_rows(df: DataFrame, cols: Sequence[str], edges: list[list[float]], label: str, key: str, fold: str | None = None) -> DataFrame:
    """``key, fold, y, x``: rows as bytes, missing values in the last bin.  Materialised, dealt by the bytes.  Forests grow from
    this plain form as from ``packed_rows``, which take a fraction of its room."""
    cuts = [np.array(e) for e in edges]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *plain, x in _binned(batches, cuts):
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in plain), _fixed(x).cast(pa.binary())], ["key", "fold", "y", "x"])

    return by_key(_raw(df, cols, label, key, fold).mapInArrow(pack, "key long, fold int, y int, x binary"), "x")


_BLOCK = "block long, x binary, groups binary, fold binary, y binary, size binary, keys binary"


@dataclass
class _Block:
    """Rows as groups of equal cell, fold and label, in this order: ``x`` are the cells, ``cell, fold, y, size`` have a value a
    group, ``keys`` one a row."""

    number: int
    x: np.ndarray
    cell: np.ndarray
    fold: np.ndarray
    y: np.ndarray
    size: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, number: int, x: np.ndarray, cell: np.ndarray, fold: np.ndarray, y: np.ndarray, size: np.ndarray | None, keys: np.ndarray) -> _Block:
        """From rows, or groups of ``size`` rows, in any order; equal cells become one."""
        coded = _fixed(x).dictionary_encode()
        cells = np.frombuffer(coded.dictionary.buffers()[1], np.uint8, len(coded.dictionary) * x.shape[1]).reshape(-1, x.shape[1])
        folds, f = np.unique(fold, return_inverse=True)
        labels, v = np.unique(y, return_inverse=True)
        code = (coded.indices.to_numpy()[cell].astype(np.int64) * len(folds) + f) * len(labels) + v
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[:len(code)]
        if size is None:
            keys, size = keys[order], np.diff(np.append(first, len(code)))
        else:
            at, size = np.cumsum(size) - size, size[order]
            keys = keys[np.repeat(at[order] - (np.cumsum(size) - size), size) + np.arange(len(keys))]
            size = np.add.reduceat(size, first)
        code = code[first]
        return cls(number, cells, code // (len(folds) * len(labels)), folds[code // len(labels) % len(folds)], labels[code % len(labels)], size, keys)

    def part(self, number: int, lo: int, hi: int) -> _Block:
        """The cells from ``lo`` to ``hi`` (groups lie in the order of their cells)."""
        a, b = np.searchsorted(self.cell, (lo, hi))
        rows = int(self.size[:a].sum()), int(self.size[:b].sum())
        return _Block(number, self.x[lo:hi], self.cell[a:b] - lo, self.fold[a:b], self.y[a:b], self.size[a:b], self.keys[rows[0]:rows[1]])

    def record(self) -> tuple:
        groups = np.bincount(self.cell, minlength=len(self.x))
        return (self.number, self.x.tobytes(), *(_narrow(v) for v in (groups, self.fold, self.y, self.size)), self.keys.astype(np.int64).tobytes())


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the greatest needs."""
    for t in (np.int8, np.int16, np.int32):
        if not len(a) or np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max:
            return a.astype(t).tobytes()
    return a.astype(np.int64).tobytes()


def _whole(b: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_narrow``."""
    return np.frombuffer(b, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(b) // max(n, 1) or 1])


def _records(blocks: Sequence[_Block]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(b.record() for b in blocks), strict=True), kinds, strict=True)],
                                      [c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[_Block]:
    for b in batches:
        for r in zip(*(b.column(i) for i in range(7)), strict=True):
            number, x, groups, fold, y, size, keys = (v.as_py() for v in r)
            x = np.frombuffer(x, np.uint8).reshape(-1, d)
            groups = _whole(groups, len(x)).astype(np.int64)
            n = int(groups.sum())
            yield _Block(number, x, np.repeat(np.arange(len(x)), groups), _whole(fold, n), _whole(y, n), _whole(size, n).astype(np.int64), np.frombuffer(keys, np.int64))


def packed_rows(df: DataFrame, cols: Sequence[str], edges: list[list[float]], label: str, key: str, fold: str | None = None) -> DataFrame:
    """The rows of ``binned_rows`` in blocks of whole cells, materialised: 8 bytes a row, and each cell once.  Tasks pack
    their rows by shares of the cells before anything moves."""
    cuts, d = [np.array(e) for e in edges], len(cols)
    parts = shuffle_partitions(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fold, y, x in _binned(batches, cuts):
            share = (_cell_hash(x) % np.uint64(parts * _SHARES)).astype(np.int64)
            order = np.argsort(share)   # cells are numbered in the order of their first rows, so shares lie together
            every = _Block.of(0, x[order], np.arange(len(x)), fold[order], y[order], None, keys[order])
            share = (_cell_hash(every.x) % np.uint64(parts * _SHARES)).astype(np.int64)
            first = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
            yield _records([every.part(int(share[lo]), lo, hi) for lo, hi in zip(first, [*first[1:], len(share)], strict=True)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Block] = []
        made, rows = TaskContext.get().partitionId() << 32, 0
        for b in _blocks(batches, d):
            if rows >= _PACK and b.number != held[-1].number or rows >= 4 * _PACK:
                yield _records([_joined(made, held)])
                held, rows, made = [], 0, made + 1
            held.append(b)
            rows += len(b.keys)
        if held:
            yield _records([_joined(made, held)])

    packed = _raw(df, cols, label, key, fold).mapInArrow(pack, _BLOCK)
    return cut_lineage(packed.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, _BLOCK))


def _joined(number: int, held: Sequence[_Block]) -> _Block:
    begin = np.cumsum([0, *(len(b.x) for b in held)])
    cat = lambda c: np.concatenate([getattr(b, c) for b in held])
    return _Block.of(number, cat("x"), np.concatenate([b.cell + n for b, n in zip(held, begin, strict=False)]), cat("fold"), cat("y"), cat("size"), cat("keys"))


def in_blocks(rows: DataFrame, d: int) -> DataFrame:
    """``packed_rows`` as they are; plain rows in the blocks of their partitions."""
    if "keys" in rows.columns:
        return rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in [*batches, None]:
            if b is not None:
                held.append(b)
                n += b.num_rows
            if n and (b is None or n >= _PACK):
                t = pa.Table.from_batches(held)
                x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(-1, d)
                keys, fold, y = (t.column(c).to_numpy() for c in ("key", "fold", "y"))
                yield _records([_Block.of(made, x, np.arange(n), fold, y, None, keys)])
                made, held, n = made + 1, [], 0

    # materialised: a block's number follows from the task that packs it
    return cut_lineage(rows.select("key", "fold", "y", "x").mapInArrow(pack, _BLOCK))


class _Draws:
    """How often the rows of each of a block's ``n`` cells are drawn for a tree, and those of label 1.

    Draws follow from seed, tree and key, so forests of one seed share them: the rows are hashed and added up by cell and fold
    once a tree, and each forest takes the folds it may see.  With ``size``, folds, labels and cells are those of groups of
    so many rows."""

    def __init__(self, keys, fold, y, cell, n: int, size=None):
        self.keys, self.y, self.n = keys, y, n
        self.first = None if size is None else np.cumsum(size) - size
        self.folds, at = np.unique(fold, return_inverse=True)
        self.place = cell.astype(np.int64) * len(self.folds) + at
        self.whole: tuple | None = None
        self.drawn: tuple = (None, None)

    @classmethod
    def of(cls, b: _Block) -> _Draws:
        return cls(b.keys, b.fold, b.y, b.cell, len(b.x), b.size)

    def _add(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.first is not None:
            w = np.add.reduceat(w, self.first, dtype=np.int64)
        both = (np.bincount(self.place, v, self.n * len(self.folds)) for v in (w, w * self.y.astype(float)))
        return tuple(v.reshape(self.n, len(self.folds)) for v in both)

    def sums(self, spec: ForestSpec, tree: int) -> tuple[np.ndarray, np.ndarray]:
        if not spec.bootstrap:   # every tree has all rows
            self.whole = self.whole or self._add(_weights(spec, tree, self.keys))
            by_fold = self.whole
        else:
            if self.drawn[0] != (spec.seed, tree):
                self.drawn = (spec.seed, tree), self._add(_weights(spec, tree, self.keys))
            by_fold = self.drawn[1]
        seen = self.folds != spec.without_fold if spec.without_fold is not None else np.ones(len(self.folds), bool)
        return tuple(v[:, seen].sum(axis=1) for v in by_fold)


def _cell_sums(spec: ForestSpec, tree: int, keys, fold, y, cell, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_Draws`` of one tree."""
    return _Draws(keys, fold, y, cell, n).sums(spec, tree)


# ---------------------------------------------------------------- growing
def grow_forests(rows: DataFrame, specs: Sequence[ForestSpec], d: int, local_rows: int = LOCAL_ROWS, kept: Sequence[int] | None = None) -> DataFrame:
    """Trees of all forests on ``packed_rows`` or ``binned_rows``: one row a tree, materialised (``fit`` is the place in
    ``specs``).  Of forests that are not ``kept`` (None: all are) the gains alone may stay."""
    specs, rows = list(specs), in_blocks(rows, d)
    if _one_task(rows, d, local_rows):
        return _grow_whole(rows, specs, d, range(len(specs)) if kept is None else kept, False).where("tree >= 0").drop("block", "s")
    return _grow_parts(rows, specs, d, local_rows)


def grow_and_score(rows: DataFrame, specs: Sequence[ForestSpec], d: int, kept: Sequence[int] = (), local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``grow_forests``, and the trees' sums on held-out cells (``_held_scores``) of every forest that leaves a fold out.  Where
    one task may hold all cells, it scores them with the trees that it grows: those need not be kept."""
    specs, rows = list(specs), in_blocks(rows, d)
    if _one_task(rows, d, local_rows):
        grown = _grow_whole(rows, specs, d, kept, True)
        return grown.where("tree >= 0").drop("block", "s"), grown.where("tree < 0").select("fit", "block", "s", (-F.col("tree")).alias("chunk"))
    trees = _grow_parts(rows, specs, d, local_rows)
    out = [i for i, s in enumerate(specs) if s.without_fold is not None]
    return trees, _held_scores(rows, trees.where(F.col("fit").isin(out)), specs, d)


def _one_task(rows: DataFrame, d: int, local_rows: int) -> bool:
    cells = int(rows.agg(F.sum(F.length("x"))).first()[0] or 0) // d
    return cells <= local_rows and cells * d <= MODEL_BYTES


def _grow_parts(rows: DataFrame, specs: list[ForestSpec], d: int, local_rows: int) -> DataFrame:
    """``grow_forests`` in two steps: shared passes down to nodes that one task may hold, then the subtrees below."""
    every = [(tree, fit) for fit, s in enumerate(specs) for tree in range(s.trees)]
    tops = _grow_top(rows, specs, d, local_rows)
    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for block in _blocks(batches, d):
            x, out, size, draws = block.x, [], 0, _Draws.of(block)
            for tree, fit in sorted(every, key=lambda k: (specs[k[1]].seed, *k)):
                spec = specs[fit]
                own, (w, hit) = spec.columns(x), draws.sums(spec, tree)
                mine = np.flatnonzero(w)
                top = tops.get((fit, tree))
                leaf = _walk(top, own[mine]) if top else np.zeros(len(mine), np.int64)
                order = np.argsort(leaf, kind="stable") if top else np.arange(len(mine))
                for at in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(mine) else []:
                    node, at = int(leaf[at[0]]), mine[at]
                    out.append((fit, tree, node, own[at].tobytes(), w[at].astype(np.uint32).tobytes(), hit[at].astype(np.uint32).tobytes()))
                    size += len(at) * (d + 8)
                if size > 32 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(_DEALT.names, r, strict=True)) for r in out], _DEALT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_DEALT.names, r, strict=True)) for r in out], _DEALT)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, tree, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
        top = shared.value.get((fit, tree))
        x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, specs[fit].width(d))
        w, hit = (np.frombuffer(b"".join(pdf[c]), np.uint32).astype(float) for c in ("w", "wy"))
        path, depth = (top[4][node], int(top[5][node])) if top else (_root(specs[fit], tree), 0)
        sub = grow_cells(x, w, hit, np.uint64(path), depth, specs[fit])
        return pd.DataFrame([(fit, tree, node, *(sub[c].tobytes() for c in ("feature", "cut", "child", "value")), list(sub["gain"]))],
                            columns=["fit", "tree", "node", "feature", "cut", "child", "value", "gain"])

    schema = _TREES.replace("tree int,", "tree int, node int,")
    dealt = rows.mapInArrow(deal, "fit int, tree int, node int, x binary, w binary, wy binary")
    # a fixed number of tasks: a subtree is much work for few bytes, and adaptive coalescing goes by bytes
    tasks = 4 * shuffle_partitions(rows.sparkSession)
    parts = dealt.repartition(tasks, "fit", "tree", "node").groupBy("fit", "tree", "node").applyInPandas(finish, schema)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """A tree of its top and the subtrees below the top's leaves."""
        fit, tree = int(pdf["fit"].iloc[0]), int(pdf["tree"].iloc[0])
        top = shared.value.get((fit, tree))
        parts = [[np.array(a, t)] for a, t in zip(top[:4], (np.int16, np.uint8, np.int32, np.float32), strict=True)]
        gain, made = np.array(top[6]), len(top[0])
        for r in pdf.itertuples():
            f, c, k, v = (np.frombuffer(b, t) for b, t in ((r.feature, np.int16), (r.cut, np.uint8), (r.child, np.int32), (r.value, np.float32)))
            k = np.where(k >= 0, k + made - 1, -1).astype(np.int32)   # the subtree's root takes the leaf's place, the rest follows the arrays
            for part, a in zip(parts, (f, c, k, v), strict=True):
                part[0][r.node] = a[0]
                part.append(a[1:])
            made += len(f) - 1
            gain = gain + np.array(r.gain)
        arrays = [np.concatenate(part) for part in parts]
        return pd.DataFrame([(fit, tree, *(a.tobytes() for a in arrays), list(gain))], columns=["fit", "tree", "feature", "cut", "child", "value", "gain"])

    if tops:
        return cut_lineage(parts.groupBy("fit", "tree").applyInPandas(join, _TREES))
    return cut_lineage(parts.drop("node"))


def _spread(spark: SparkSession, n: int) -> list[int]:
    """``n`` whole numbers, each alone in one of ``n`` partitions by its hash."""
    got = spark.range(40 * n).selectExpr("int(id) AS id", f"pmod(hash(int(id)), {n}) AS p").groupBy("p").agg(F.min("id").alias("id")).collect()
    alone = [r["id"] for r in got]
    return (alone + [40 * n + i for i in range(n)])[:n]


def _grow_whole(rows: DataFrame, specs: list[ForestSpec], d: int, kept: Sequence[int], scored: bool) -> DataFrame:
    """Forests where one task may hold all cells: these are broadcast once, and a task brings together their weights for some
    draws, from each of which all forests that share it grow a tree.  Materialised; where ``scored``, rows with ``tree`` below
    0 have the sums of a forest's trees of a task, ``s``, over the cells of a ``block``."""
    held = sorted(((r["block"], np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, d)) for r in rows.select("block", "x").toLocalIterator()), key=lambda h: h[0])
    kept, plan = set(kept), {}
    for fit, spec in enumerate(specs):
        for tree in range(spec.trees):
            plan.setdefault((spec.seed, spec.bootstrap, -1 if spec.without_fold is None else spec.without_fold), {}).setdefault(tree, []).append(fit)
    # trees of equal draws lie a round apart: every task gets as many of each forest
    sc, share = rows.sparkSession.sparkContext, []
    rounds = max(1, math.ceil(4 * sc.defaultParallelism / max(len(plan), 1)))
    for of in plan.values():
        parts = [{t: fits for t, fits in of.items() if t % rounds == i} for i in range(rounds)]
        share += [p for p in parts if p]
    share = dict(zip(_spread(rows.sparkSession, len(share)), share, strict=True))
    draws_of = sorted((t, i, fits) for i, p in share.items() for t, fits in p.items())
    shared = sc.broadcast(([n for n, _ in held], np.concatenate([np.zeros((0, d), np.uint8), *(x for _, x in held)]), [len(x) for _, x in held]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for block in _blocks(batches, d):
            out, size, draws = [], 0, _Draws.of(block)
            for at, (tree, i, fits) in enumerate(draws_of):
                w, hit = (_narrow(v) for v in draws.sums(specs[fits[0]], tree))
                out.append((i, tree, block.number, w, hit))
                size += len(w) + len(hit)
                if size > 32 << 20 or at + 1 == len(draws_of):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["share", "tree", "block", "w", "hit"])
                    out, size = [], 0

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["share"].iloc[0])
        numbers, every, sizes = shared.value
        begin = np.append(0, np.cumsum(sizes)).astype(int)
        out, sums = [], {}
        for tree, part in pdf.groupby("tree"):
            of = {r.block: (r.w, r.hit) for r in part.itertuples()}
            w, hit = (np.concatenate([_whole(of[b][k], n) for b, n in zip(numbers, sizes, strict=True)]) for k in range(2))
            mine = np.flatnonzero(w)
            w, hit = w[mine].astype(float), hit[mine].astype(float)
            for fit in share[i][tree] if len(mine) else []:
                spec = specs[fit]
                own = spec.columns(every)
                sub = grow_cells(own[mine], w, hit, _root(spec, tree), 0, spec)
                out.append((fit, tree, *(sub[c].tobytes() if fit in kept else b"" for c in ("feature", "cut", "child", "value")), list(sub["gain"]), None, b""))
                if scored and spec.without_fold is not None:
                    sums[fit] = sums.get(fit, 0.0) + sub["value"][_walk((sub["feature"], sub["cut"], sub["child"]), own)].astype(float)
        for fit, s in sums.items():
            out += [(fit, -1 - i, *[b""] * 4, [], b, s[lo:hi].tobytes()) for b, lo, hi in zip(numbers, begin[:-1], begin[1:], strict=True)]
        return pd.DataFrame(out, columns=["fit", "tree", "feature", "cut", "child", "value", "gain", "block", "s"]).astype({"block": "Int64"})

    # one task a share: a tree is much work for few bytes, and adaptive coalescing goes by bytes
    return cut_lineage(rows.mapInArrow(deal, "share int, tree int, block long, w binary, hit binary").repartition(max(len(share), 1), "share")
                       .groupBy("share").applyInPandas(finish, f"{_TREES}, block long, s binary"))


_DEALT = pa.schema([("fit", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("x", pa.binary()), ("w", pa.binary()), ("wy", pa.binary())])


def _grow_top(rows: DataFrame, specs: list[ForestSpec], d: int, local_rows: int) -> dict:
    """Tops of the trees, down to nodes of at most ``local_rows`` cells.

    A top is (feature, cut, child, value, path, depth, gain): as many nodes as the table has multiples of ``local_rows``.
    """
    tops = {(fit, tree): ([-1], [0], [-1], [0.0], [_root(spec, tree)], [0], np.zeros(spec.width(d))) for fit, spec in enumerate(specs) for tree in range(spec.trees)}
    wanted = {k: [0] for k in tops}
    while wanted:
        shared = rows.sparkSession.sparkContext.broadcast(({k: tuple(np.array(a) for a in t[:3]) for k, t in tops.items()}, wanted))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, wanted = shared.value  # noqa: B023
            for block in _blocks(batches, d):
                x, draws = block.x, _Draws.of(block)
                for (fit, tree), nodes in sorted(wanted.items(), key=lambda k: (specs[k[0][0]].seed, k[0][1], k[0][0])):
                    spec = specs[fit]
                    w, hit = draws.sums(spec, tree)
                    own = spec.columns(x)
                    width = own.shape[1]
                    place = np.full(len(tops[fit, tree][0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    mine = place[_walk(tops[fit, tree], own)]
                    at = np.flatnonzero((mine >= 0) & (w > 0))
                    code = ((mine[at, None] * width + np.arange(width)) * 256 + own[at]).ravel()
                    space = len(nodes) * width * 256
                    both = [np.bincount(code, np.repeat(v[at], width), space) for v in (w, hit)]
                    met = np.flatnonzero(both[0])
                    held = np.bincount(mine[at], minlength=len(nodes))   # cells of each node, as number -1
                    node = np.concatenate([np.array(nodes)[met // (width * 256)], nodes])
                    n = len(node)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.full(n, v), pa.int32()) for v in (fit, tree)), pa.array(node, pa.int32()),
                         pa.array(np.concatenate([met % (width * 256), np.full(len(nodes), -1)]), pa.int32()),
                         pa.array(np.concatenate([both[0][met], held])), pa.array(np.concatenate([both[1][met], np.zeros(len(nodes))]))],
                        ["fit", "tree", "node", "cell", "w", "wy"])

        paths = {(k, n): tops[k][4][n] for k, ns in wanted.items() for n in ns}

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            fit, tree, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
            spec, path = specs[fit], np.array([paths[(fit, tree), node]], np.uint64)  # noqa: B023
            cell, w, wy = (pdf[c].to_numpy() for c in ("cell", "w", "wy"))
            cells = w[cell < 0].sum()
            cell, w, wy = (a[cell >= 0] for a in (cell, w, wy))
            own = cell // 256 == cell[:1] // 256
            total, total_y = np.array([w[own].sum()]), np.array([wy[own].sum()])
            order, m = _order(path, spec.width(d)), spec.candidates(spec.width(d))
            slot_of = np.argsort(order[0])
            best = (-1, 0, 0.0, 0.0)
            for slots in (range(m), range(m, spec.width(d))):
                slot = slot_of[cell // 256] - slots.start
                mine = np.flatnonzero((slot >= 0) & (slot < len(slots)))
                mine = mine[np.lexsort((cell[mine] % 256, slot[mine]))]
                near = order[:, slots.start:slots.stop]
                s, c, a, y = _best(np.zeros(len(mine), np.int64), slot[mine], cell[mine] % 256, w[mine], wy[mine], total, total_y, path, near, spec)
                if s[0] >= 0:
                    best = (int(near[0, s[0]]), int(c[0]), float(a[0]), float(y[0]))
                    break
            return pd.DataFrame([(fit, tree, node, *best, total[0], total_y[0], cells)], columns=["fit", "tree", "node", "f", "c", "lw", "ly", "n", "ny", "cells"])

        cells = (rows.mapInArrow(count, "fit int, tree int, node int, cell int, w double, wy double")
                 .groupBy("fit", "tree", "node", "cell").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")))
        found = cells.groupBy("fit", "tree", "node").applyInPandas(choose, "fit int, tree int, node int, f int, c int, lw double, ly double, n double, ny double, cells double").collect()
        wanted = {}
        for r in sorted(found, key=lambda r: (r["fit"], r["tree"], r["node"])):
            k, spec = (r["fit"], r["tree"]), specs[r["fit"]]
            feature, cut, child, value, path, depth, gain = tops[k]
            at = r["node"]
            value[at] = r["ny"] / max(r["n"], 1e-300)
            if r["f"] < 0 or not _open(r["n"], r["ny"], depth[at], spec) or r["cells"] <= local_rows:
                continue   # a leaf, or small enough for one task
            feature[at], cut[at], child[at] = r["f"], r["c"], len(feature)
            gain[r["f"]] += _gain(r["n"], r["ny"], r["lw"], r["ly"])
            for side, n in zip(_children(np.array([path[at]], np.uint64)), (r["lw"], r["n"] - r["lw"]), strict=True):
                feature.append(-1), cut.append(0), child.append(-1), value.append(0.0), path.append(side[0]), depth.append(depth[at] + 1)
                if n > local_rows:
                    wanted.setdefault(k, []).append(len(feature) - 1)
    return {k: (*(np.array(a) for a in t[:6]), t[6]) for k, t in tops.items()}


# ---------------------------------------------------------------- scoring
def _decoded(r) -> tuple:
    return (r["fit"], *(np.frombuffer(bytes(r[c]), t) for c, t in (("feature", np.int16), ("cut", np.uint8), ("child", np.int32), ("value", np.float32))))


def _chunks(trees: DataFrame) -> Iterator[list]:
    """Trees in groups of at most ``MODEL_BYTES``; a single tree above it is an error that a depth limit mends."""
    sizes = trees.select("fit", "tree", F.expr("length(feature) + length(cut) + length(child) + length(value)").alias("n")).orderBy("fit", "tree").collect()
    group, size = [], 0
    for r in [*sizes, None]:
        if r is not None and r["n"] > MODEL_BYTES:
            raise ValueError(f"a tree of {r['n']} bytes can't be broadcast; set a depth")
        if group and (r is None or size + r["n"] > MODEL_BYTES):
            lo, hi = group[0], group[-1]
            inside = F.struct("fit", "tree").between(F.struct(F.lit(lo[0]), F.lit(lo[1])), F.struct(F.lit(hi[0]), F.lit(hi[1])))
            yield [_decoded(t) for t in trees.where(inside).orderBy("fit", "tree").collect()]
            group, size = [], 0
        if r is not None:
            group.append((r["fit"], r["tree"]))
            size += r["n"]


def _held_scores(rows: DataFrame, trees: DataFrame, specs: list[ForestSpec], d: int) -> DataFrame:
    """``fit, block, s, chunk``: sums over a chunk of a forest's trees for the cells of a block."""
    out = None
    for number, chunk in enumerate(_chunks(trees)):
        shared = rows.sparkSession.sparkContext.broadcast(chunk)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_fit: dict = {}
            for t in shared.value:  # noqa: B023
                by_fit.setdefault(t[0], []).append(t)
            for block in _blocks(batches, d):
                sums = []
                for fit, own in sorted(by_fit.items()):
                    x = np.ascontiguousarray(specs[fit].columns(block.x))
                    sums.append(sum((t[4][_walk(t[1:], x)].astype(float) for t in own), np.zeros(len(x))).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sorted(by_fit), pa.int32()), pa.array([block.number] * len(sums), pa.int64()), pa.array(sums, pa.binary())],
                                                 ["fit", "block", "s"])

        part = rows.mapInArrow(score, "fit int, block long, s binary").withColumn("chunk", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "fit int, block long, s binary, chunk int")


def _by_block(rows: DataFrame, scores: DataFrame, specs: list[ForestSpec], d: int, f, schema: str) -> DataFrame:
    """``f(block, fit, p)`` frames of every block and forest; ``p`` is the mean over all its trees for each cell."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = int(pdf["fit"].iloc[0])
        s = sum((np.frombuffer(b) for b in pdf.sort_values("chunk")["s"]), 0.0)
        return pd.DataFrame([(fit, pdf["block"].iloc[0], (s / specs[fit].trees).tobytes())], columns=["fit", "block", "p"])

    def each(scores: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = [f(block, int(r.fit), np.frombuffer(r.p)) for block in _blocks([pa.RecordBatch.from_pandas(blocks[names], preserve_index=False)], d) for r in scores.itertuples()]
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    means = scores.groupBy("fit", "block").applyInPandas(mean, "fit int, block long, p binary")
    return means.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(each, schema)


def held_out_rows(rows: DataFrame, scores: DataFrame, specs: Sequence[ForestSpec], d: int) -> DataFrame:
    """``fit, key, y, p, rows``: mean share of label 1 over a forest's trees for every row of the fold that it was grown
    without.  Rows that share a key and a label (equal rows, where the key is a hash of the row) are one row with its count."""
    specs, rows = list(specs), in_blocks(rows, d)

    def expand(block: _Block, fit: int, p: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(block.fold == specs[fit].without_fold)
        n, keys = block.size[at], block.keys[np.repeat(block.fold == specs[fit].without_fold, block.size)]
        return pd.DataFrame({"fit": np.full(len(keys), fit), "key": keys, "y": np.repeat(block.y[at], n), "s": np.repeat(p[block.cell[at]], n)})

    each = _by_block(rows, scores, specs, d, expand, "fit int, key long, y int, s double")
    return each.groupBy("fit", "key", "y").agg(F.avg("s").alias("p"), F.count(F.lit(1)).alias("rows"))


def held_out_sums(rows: DataFrame, trees: DataFrame, specs: Sequence[ForestSpec], d: int) -> DataFrame:
    """``held_out_rows`` of trees that are at hand."""
    rows = in_blocks(rows, d)
    return held_out_rows(rows, _held_scores(rows, trees, list(specs), d), specs, d)


def held_out_accuracy(rows: DataFrame, scores: DataFrame, specs: Sequence[ForestSpec], d: int) -> dict[int, float]:
    """Accuracy of each forest on the rows of the fold that it was grown without, counted by cells: no row is scored or moved
    by itself."""
    specs, rows = list(specs), in_blocks(rows, d)

    def count(block: _Block, fit: int, p: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(block.fold == specs[fit].without_fold)
        right = (p[block.cell[at]] > 0.5).astype(int) == block.y[at]
        return pd.DataFrame({"fit": [fit], "good": [block.size[at][right].sum()], "n": [block.size[at].sum()]})

    counted = _by_block(rows.withColumn("keys", F.lit(b"")), scores, specs, d, count, "fit int, good long, n long")
    return {r["fit"]: r["a"] for r in counted.groupBy("fit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).where("n > 0").selectExpr("fit", "good / n AS a").collect()}


def importances(trees: DataFrame, names: Sequence[str]) -> DataFrame:
    """``fit, feature, importance``: each tree's impurity decreases brought to sum 1, then averaged."""
    one = trees.select("fit", F.expr("aggregate(gain, 0D, (a, x) -> a + x)").alias("all"), F.posexplode("gain").alias("f", "g"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1)
    return one.groupBy("fit", name.alias("feature")).agg(F.avg(F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0)).alias("importance"))


class ForestModel(TableModel):
    """A fitted forest as a pipeline stage: the state has one row a tree, ``edges`` the bins of each place of ``featuresCol``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    edges = Param(Params._dummy(), "edges", "cut values of each feature, as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, trees: DataFrame, edges: list[list[float]], features: str = "features") -> ForestModel:
        return cls(trees)._set(edges=json.dumps(edges), featuresCol=features)

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        d = len(json.loads(self.getOrDefault("edges")))
        got = {r["feature"]: r["importance"] for r in importances(self.state, [str(i) for i in range(d)]).collect()}
        return Vectors.dense([got.get(str(i), 0.0) for i in range(d)])

    def _transform(self, df: DataFrame) -> DataFrame:
        cuts = [np.array(e) for e in json.loads(self.getOrDefault("edges"))]
        sums, n = [], 0
        out = df.withColumn("_x", vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        for chunk in _chunks(self.state):
            shared = df.sparkSession.sparkContext.broadcast(chunk)

            @F.pandas_udf("double")
            def total(v: pd.Series) -> pd.Series:
                if not len(v):
                    return pd.Series([], dtype=float)
                raw = np.stack(v.to_numpy())
                x = np.stack([np.searchsorted(c, raw[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                s = np.zeros(len(x))
                for t in shared.value:  # noqa: B023
                    s += t[4][_walk(t[1:], x)]
                return pd.Series(s)

            out = out.withColumn(f"_s{len(sums)}", total("_x"))
            sums.append(F.col(f"_s{len(sums)}"))
            n += len(chunk)
        p = sum(sums[1:], sums[0]) / F.lit(float(n)) if sums else F.lit(0.0)
        out = out.withColumn("_p", p)
        return (out.withColumns({"probability": array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")})
                .drop("_x", "_p", *[f"_s{i}" for i in range(len(sums))]))


class Forest(Estimator):
    """One forest on a (``features`` vector, ``label``, key) table; where ``whole``, missing labels and features that are not
    finite are an error."""

    def __init__(self, spec: ForestSpec, key: str = "row_key", local_rows: int = LOCAL_ROWS, whole: bool = False):
        super().__init__()
        self.spec, self.key, self.local_rows, self.whole = spec, key, local_rows, whole

    def _fit(self, df: DataFrame) -> ForestModel:
        odd = F.exists(vector_to_array("features"), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        if self.whole and not df.where(F.col("label").isNull() | F.isnan(F.col("label").cast("double")) | odd).isEmpty():
            raise ValueError("labels must not be null or NaN and features must be finite")
        return fit_forests(df, [self.spec], self.key, self.local_rows)[0]


def vector_columns(df: DataFrame, features: str = "features") -> tuple[DataFrame, list[str]]:
    """``df`` with one column a place of its feature vector."""
    d = df.select(F.size(vector_to_array(features))).first()
    names = [f"_f{i}" for i in range(d[0] if d else 0)]
    a = df.withColumn("_a", vector_to_array(features))
    return a.withColumns({n: F.col("_a")[i] for i, n in enumerate(names)}).drop("_a"), names


def fit_forests(df: DataFrame, specs: Sequence[ForestSpec], key: str = "row_key", local_rows: int = LOCAL_ROWS, fold: str | None = None) -> list[ForestModel]:
    """Models of several forests on one (``features``, ``label``, key[, fold]) table, grown together.  Without a column ``key``
    rows are told apart by their content."""
    if key not in df.columns:
        df = df.withColumn(key, F.xxhash64(vector_to_array("features"), *[F.col(f"`{c}`") for c in df.columns if c != "features"]))
    wide, names = vector_columns(df)
    edges = feature_edges(wide, names)
    trees = grow_forests(packed_rows(wide, names, edges, "label", key, fold), specs, len(names), local_rows)
    return [ForestModel.of(trees.where(F.col("fit") == i), edges) for i in range(len(specs))]
