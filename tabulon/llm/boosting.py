"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 13).

Every document becomes a row of statistics of its words, lines and characters.  Statistics are cut into bins at quantiles of
the training rows; trees grow level by level from histograms of gradients and curvatures of the logistic loss by node,
statistic and bin.  A fitted model is three arrays over complete binary trees, walked for all rows and all trees at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import lowest_by_hash, text_bytes

#: Labelled rows that the trees are fitted on at most: those of lowest id hash.
MAX_LABELLED = 30_000
THRESHOLD = 0.7
#: Trees, their depth, shrinkage, bins, least curvature in a leaf and penalty on leaf values.
TREES, DEPTH, RATE, BINS, LEAST, PENALTY = 80, 4, 0.15, 64, 2.0, 1.0
#: Words of a window in which the worst share of capitals and symbols is looked for.
WINDOW = 40
STATS = ("log_words", "word_length", "longest_word", "distinct", "commonest", "same_as_last", "lines", "line_words", "dup_lines",
         "upper", "digits", "symbols", "marks", "high_bytes", "marked_words", "capital_words", "worst_symbols", "worst_upper", "lone_marks")

_IS = {name: np.isin(np.arange(256), np.frombuffer(members, np.uint8)) for name, members in {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "symbol": b"#*$%&|<>@^~_=+\\{}[]", "mark": b"!?.,;:'\"()-/", "high": bytes(range(128, 256))}.items()}


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves remainder 2 by 4; their labels are never learned from.  A null id is never
    held out and never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def describe(data: bytes) -> list[float]:
    """``STATS`` of one text in UTF-8; 0 where there is nothing to count."""
    words = data.split()
    if not words:
        return [0.0] * len(STATS)
    n, raw = len(words), np.frombuffer(data, np.uint8)
    by = np.bincount(raw, minlength=256)
    some = {k: int(by[m].sum()) for k, m in _IS.items()}
    ink = len(raw) - int(by[9:14].sum() + by[32])
    letters = max(1, some["upper"] + some["lower"])
    lines = [x for x in data.split(b"\n") if x.strip()]
    counted = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    starts = np.fromiter((w[0] for w in words), np.uint8, n)
    # running counts of symbols and capitals before every word's start, for windows of words
    place = np.concatenate(([0], np.cumsum(sizes)))
    inked = np.frombuffer(b"".join(words), np.uint8)
    at = place[np.append(np.arange(0, n, WINDOW), n)]
    worst = [float((np.add.reduceat(_IS[k][inked], at[:-1]) / np.diff(at)).max()) for k in ("symbol", "upper")]
    return [math.log1p(n), ink / n, math.log1p(int(sizes.max())), len(counted) / n, max(counted.values()) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(len(lines)), math.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines), some["upper"] / letters, some["digit"] / ink, some["symbol"] / ink, some["mark"] / ink,
            some["high"] / ink, float((_IS["symbol"][ends] | (ends == 33)).mean()), float(_IS["upper"][starts].mean()), *worst,
            sum(len(w) == 1 and not (w.isalnum() or w[0] >= 128) for w in words) / n]


@dataclass
class Boosted:
    """Trees as arrays over complete heaps: ``feature`` and ``cut`` of inner nodes, ``value`` of the bottom row (a leaf higher up
    has its value in every place below it, and a cut that sends all rows left)."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    base: float = 0.0


def margins(arrays: tuple, x: np.ndarray) -> np.ndarray:
    """Sum of all trees' values for rows of statistics: every step moves all rows one level down in all trees."""
    feature, cut, value, base = arrays
    trees, inner = feature.shape
    if not trees:
        return np.full(len(x), base)
    rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
    node = np.zeros((len(x), trees), np.int64)
    while node[0, 0] < inner:
        node = 2 * node + 1 + (x[rows, feature[tree, node]] > cut[tree, node])
    return base + value[tree, node - inner].sum(axis=1)


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut values of each statistic: different quantiles of its values, none above the largest but one."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        out.append(q[q < column.max()])
    return out


def split(gradient: np.ndarray, curvature: np.ndarray, penalty: float = PENALTY, least: float = LEAST) -> tuple[np.ndarray, ...]:
    """Best cut of every node from its histograms (node, statistic, bin): statistic, bin and gain; rows in bins up to the one
    named go left.  Ties go to the first statistic and bin."""
    g, h = gradient.cumsum(axis=2), curvature.cumsum(axis=2)
    all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
    gain = g**2 / (h + penalty) + (all_g - g)**2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
    gain = np.where((h >= least) & (all_h - h >= least), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Boosted:
    """Fit on rows ``x`` with labels ``y`` of 0 and 1.  With one kind of label there are no trees, only a constant."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return Boosted(base=base)
    cuts = edges(x, bins)
    n, d = x.shape
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    inner, bottom = 2**depth - 1, 2**depth
    out = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, bottom)), base)
    slot = np.arange(d)[None, :] * bins + binned
    margin, rows = np.full(n, base), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # place in the level
        for level in range(depth):
            width = 2**level
            where = (node[:, None] * (d * bins) + slot).ravel()
            grad, curve = (np.bincount(where, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h))
            f, b, gain = split(grad, curve)
            for k in np.flatnonzero(gain > 1e-9):
                out.feature[t, width - 1 + k], out.cut[t, width - 1 + k] = f[k], cuts[f[k]][b[k]]
            right = (gain[node] > 1e-9) & (binned[rows, f[node]] > b[node])
            node = 2 * node + right
        total_g, total_h = np.bincount(node, g, bottom), np.bincount(node, h, bottom)
        out.value[t] = -rate * total_g / (total_h + PENALTY)
        margin += out.value[t][node]
    return out


def statistics_column(text: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([describe(x.as_py()) for x in batch], pa.list_(pa.float64()))

    return stats(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, **settings) -> Boosted:
    """Fit on labelled rows that are not held out (``held_out``), those of lowest id hash up to ``max_labelled``.

    Null labels and ids are passed over; several labels of one id count as its lowest, and of several texts of one id the one
    with the least statistics.  Only statistics reach the driver, one row an id.  Without labelled rows the score is 0.5.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
             .groupBy("id").agg(F.min("label").alias("label")))
    chosen = lowest_by_hash(known, "id", max_labelled)  # bounded, so it may be broadcast
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("text")).join(F.broadcast(chosen), "id")
            .select("id", "label", statistics_column(F.col("text")).alias("x"))
            .groupBy("id", "label").agg(F.min("x").alias("x")).collect())
    if not rows:
        return Boosted()
    rows.sort(key=lambda r: r["id"])  # the fit doesn't depend on partitions
    return boost(np.array([r["x"] for r in rows]), np.array([r["label"] > 0 for r in rows], float), **settings)


def score(docs: DataFrame, model: Boosted, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with column ``out`` (replaced if it is there): from 0 to 1, higher where label 1 is likelier.  Whole texts are
    read; null and empty texts score as rows of zeros."""
    from pyspark.sql.functions import arrow_udf

    arrays = (model.feature, model.cut, model.value, model.base)

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([describe(t.as_py()) for t in batch]).reshape(len(batch), -1)
            yield pa.array(1 / (1 + np.exp(-np.clip(margins(arrays, x), -60, 60))) if len(x) else [], pa.float64())

    return docs.withColumn(out, scored(text_bytes(text_col)))
