"""Quality rules and an isolation forest over their statistics (operator 6).

Every document is reduced to a fixed row of rule statistics.  Trees that split random features at random values
isolate unusual rows after few splits; the score is the usual ``2 ** (-mean path length / c(psi))``.  The
threshold is calibrated on labelled rows: the score that parts bad from good rows best among those that keep a
given share of the good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import lowest_by_hash, text_bytes, through_table

#: Rows to a tree and number of trees: the method's own bounded sample, taken by lowest id hash.
PSI, TREES = 256, 128
#: Share of good labelled rows that the threshold must keep, and bins of the calibration histogram.
KEEP_GOOD, BINS = 0.995, 2000
#: Base rules: least words, and the most words in repeated windows (a share of all).
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 0.2, 5
#: The symbol characters.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the forest sees, computed from the counts and a few more.
STATS = ("log_words", "mean_word", "symbols", "dup_lines", "repeated", "distinct", "upper", "digits", "marks", "line_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(words: list[bytes], n: int = WINDOW) -> int:
    """Words covered by n-word windows that occur at least twice (64-bit hashes of words and windows)."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    k = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        k = k * np.uint64(0x9E3779B97F4A7C15) + (h[i:len(h) - n + 1 + i] ^ (h[i:len(h) - n + 1 + i] >> np.uint64(29)))
    order = np.sort(k)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, k)
    hit = twice[np.minimum(at, len(twice) - 1)] == k
    cover = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def describe(data: bytes) -> tuple[list[int], list[float]]:
    """Counts and statistics of one text in UTF-8."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    raw = np.frombuffer(data, np.uint8)
    by = np.bincount(raw, minlength=256)
    white = int(by[9:14].sum() + by[32])
    points = len(raw) - int(by[0x80:0xC0].sum())  # every byte but continuation bytes starts a code point
    n, chars, symbols = len(words), points - white, int(by[_SYMBOL].sum())
    dup, rep = len(lines) - len(set(lines)), _repeated(words)
    one, c = max(1, n), max(1, chars)
    letters = int(by[65:91].sum() + by[97:123].sum())
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    stats = [math.log1p(n), chars / one, symbols / one, dup / max(1, len(lines)), rep / one, len(set(words)) / one * math.sqrt(math.log1p(one)),
             int(by[65:91].sum()) / max(1, letters), int(by[48:58].sum()) / c, marks / c, math.log1p(n / max(1, len(lines)))]
    return [n, chars, symbols, dup, rep], stats


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the rule counts (``COUNTS``, long) and ``stats`` (array of ``STATS``) of each whole text; null
    counts as empty.  Columns of these names are replaced."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",stats:array<double>>")
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [describe(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays(
                [*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))], [*COUNTS, "stats"])

    out = docs.withColumn("_rules", rules(text_bytes(text_col)))
    return out.withColumns({c: F.col(f"_rules.{c}") for c in (*COUNTS, "stats")}).drop("_rules")


def base_failed() -> Column:
    """Base rules on the columns of ``statistics``: too few words, or too many in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MAX_REPEATED) * F.col("n_words"))


@dataclass
class IsolationForest:
    """Trees as arrays ``feature`` (-1: leaf), ``value`` (split, or path length at a leaf) over complete heaps."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    depth: int = 0
    scale: float = 1.0
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1 of rows of statistics; 0 without trees."""
        if not len(self.feature):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value in zip(self.feature, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= value[node]), node)
            total += value[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(sample: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 0) -> IsolationForest:
    """Forest over rows of statistics, each tree on ``psi`` of them."""
    rng = np.random.default_rng(seed)
    psi = min(psi, len(sample))
    if psi < 2:
        return IsolationForest()
    depth = math.ceil(math.log2(psi))
    feature, value = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int64), np.zeros((trees, 2 ** (depth + 1) - 1))
    for t in range(trees):
        todo = [(0, sample[rng.choice(len(sample), psi, replace=False)], 0)]
        while todo:
            node, rows, at = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if at == depth or len(rows) < 2 or not len(open_):
                value[t, node] = at + _path(len(rows))
                continue
            f = int(rng.choice(open_))
            feature[t, node], value[t, node] = f, rng.uniform(low[f], high[f])
            right = rows[:, f] >= value[t, node]
            if right.all() or not right.any():  # a split at the lowest value parts nothing
                value[t, node] = np.nextafter(low[f], high[f])
                right = rows[:, f] >= value[t, node]
            todo += [(2 * node + 1, rows[~right], at + 1), (2 * node + 2, rows[right], at + 1)]
    return IsolationForest(feature, value, depth, _path(psi))


def score_column(forest: IsolationForest, stats: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(forest.score(batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(STATS))))

    return score(stats)


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", keep_good: float = KEEP_GOOD,
        trees: int = TREES, psi: int = PSI) -> IsolationForest:
    """Forest on a bounded sample (``trees * psi`` rows of lowest id hash) of a frame with ``stats``, and its threshold.

    The threshold is the score at which labelled rows that pass the base rules are parted best (share of bad rows
    above it minus share of good rows above it) among those with at least ``keep_good`` of the good rows below it;
    every labelled row counts, through a histogram.  Null labels are passed over; without both kinds of labels
    nothing is rejected.  Several labels of one id count as its lowest.
    """
    rows = lowest_by_hash(described.select("stats", F.col(f"`{id_col}`").alias("id")), "id", trees * psi).select("stats").collect()
    forest = grow(np.array([r["stats"] for r in rows]).reshape(len(rows), len(STATS)), trees, psi)
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{good_col}`").cast("int").alias("good"))
             .filter("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good")))
    bins = (described.filter(~base_failed()).select(F.col(f"`{id_col}`").alias("id"), "stats").join(known, "id")
            .select("good", F.least(F.floor(score_column(forest, F.col("stats")) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
            .groupBy("bin").agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")).collect())
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["n"] - r["good"]
    if good.sum() and bad.sum():
        above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()
        gain = np.where(above(good) <= 1 - keep_good, above(bad) - above(good), -1.0)
        if gain.max() > 0:
            forest.threshold = float(np.argmax(gain)) / BINS
    return forest


def judge(described: DataFrame, forest: IsolationForest) -> DataFrame:
    """``described`` with ``base_failed``, ``anomaly`` (score) and ``kept``: false if a base rule fails, else whether the
    score lies below the threshold."""
    out = described.withColumns({"base_failed": base_failed(), "anomaly": score_column(forest, F.col("stats"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(forest.threshold)))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, forest and verdict over a table: ``doc_id`` and the columns of ``judge``.  Texts are read once;
    the reduced rows go through the shared folder.  An empty table stays empty."""
    described = through_table(statistics(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
                              .drop("text"), "quality_stats")
    return judge(described, fit(described, labels.withColumnRenamed(id_col, "doc_id")))
