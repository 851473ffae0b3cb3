"""Isolation-forest outlier flag.

Spark has no isolation forest, so it is built from DataFrame pieces:

* sampling — one Bernoulli pre-sample of about ``2 * trees * psi`` rows
  (bounded, independent of data size), then ``psi`` rows per tree chosen by
  smallest ``xxhash64(row key, tree, seed)`` inside that sample;
* growing — ``groupBy("tree").applyInPandas`` grows each tree from its
  ``psi`` rows (random feature, uniform split in the node's range, depth
  limit ``ceil(log2 psi)``); the forest is at most ``trees * (2 psi - 1)``
  nodes, so shipping it to the executors is a bounded broadcast;
* scoring — ``mapInPandas`` walks all trees for a batch of rows with numpy;
* cut — rows whose score exceeds the exact (1 − contamination) quantile
  of the training scores are flagged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabulon.plans.ordering import exact_quantiles
from tabulon.session import cut_lineage, shuffle_partitions

_EULER = 0.5772156649015329


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, features: list[str], seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed * 100003 + tree)
    X = pdf[features].to_numpy(dtype=np.float64)
    rows = []  # tree, node, feature, threshold, left, right, size, depth

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = build(idx[sub[:, f] < thr], depth + 1)
        right = build(idx[sub[:, f] >= thr], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
        return node

    build(np.arange(len(X)), 0)
    out = pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    # path length credited at a leaf: its depth plus the expected depth of the unbuilt subtree
    out["path"] = out["depth"] + out["size"].map(_c)
    return out


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str | None = None, trees: int = 100,
                         psi: int = 256, seed: int = 42) -> tuple[list[pd.DataFrame], int]:
    """Grow the forest; returns (per-tree node tables, effective sample size).

    Rows are sampled by a hash of ``key`` (all columns where none is given), so the forest does not depend on partitions.
    """
    features = list(features)
    base = df.select(*[F.col(c).cast("double").alias(c) for c in features],
                     (F.col(key) if key else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_key"))
    base = base.na.drop(subset=features)
    n = base.count()
    psi_eff = min(psi, n)
    frac = min(1.0, 2.0 * trees * psi_eff / max(n, 1))
    chance = F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    # the per-tree explode below multiplies rows by `trees`: deal the pool by key first
    pool = base.where(chance < frac).repartition(shuffle_partitions(df.sparkSession), "_key")
    # for each tree keep the psi rows with the smallest hash.  The explode of the bounded pool is
    # filtered by a hash threshold first (about 3 psi rows per tree survive), so only
    # trees * 3 psi rows are shuffled and sorted, never the whole exploded pool.
    pool_size = max(frac * n, 1.0)
    keep = min(1.0, 3.0 * psi_eff / pool_size)
    h = F.xxhash64("_key", "tree", F.lit(seed))
    per_tree = (pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
                .withColumn("_h", h)
                .where((F.abs(F.col("_h") % 1000003) / 1000003.0) < keep))
    w = Window.partitionBy("tree").orderBy("_h", *features)
    samples = per_tree.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi_eff)
    max_depth = int(math.ceil(math.log2(max(psi_eff, 2))))
    schema = ("tree long, node long, feature long, threshold double, left long, right long, size long, depth long, "
              "path double")
    nodes = (samples.select("tree", "_rk", *features).groupBy("tree")
             .applyInPandas(lambda p: _grow(p.sort_values("_rk").reset_index(drop=True), features, seed, max_depth), schema))
    pdf = nodes.toPandas()          # bounded: trees * (2 psi - 1) rows
    return [g.sort_values("node").reset_index(drop=True) for _, g in pdf.groupby("tree")], psi_eff


def _stack(forest: list[pd.DataFrame]) -> dict[str, np.ndarray]:
    """All trees as one node table with global child indices (bounded: trees * (2 psi - 1) rows)."""
    feats, thrs, lefts, rights, paths, roots = [], [], [], [], [], []
    offset = 0
    for t in forest:
        n = len(t)
        roots.append(offset)
        feats.append(t["feature"].to_numpy())
        thrs.append(t["threshold"].to_numpy())
        left = t["left"].to_numpy()
        right = t["right"].to_numpy()
        lefts.append(np.where(left >= 0, left + offset, -1))
        rights.append(np.where(right >= 0, right + offset, -1))
        paths.append(t["path"].to_numpy())
        offset += n
    return {"feature": np.concatenate(feats), "threshold": np.concatenate(thrs), "left": np.concatenate(lefts),
            "right": np.concatenate(rights), "path": np.concatenate(paths), "roots": np.array(roots)}


def _path_lengths(X: np.ndarray, forest) -> np.ndarray:
    """Mean path length over all trees, walking every (row, tree) pair at once."""
    st = forest if isinstance(forest, dict) else _stack(forest)
    feat, thr, left, right = st["feature"], st["threshold"], st["left"], st["right"]
    node = np.broadcast_to(st["roots"], (len(X), len(st["roots"]))).copy()
    rows = np.arange(len(X))[:, None]
    while True:
        f = feat[node]
        internal = f >= 0
        if not internal.any():
            break
        x = X[rows, np.where(internal, f, 0)]
        nxt = np.where(x < thr[node], left[node], right[node])
        node = np.where(internal, nxt, node)
    return st["path"][node].mean(axis=1)


def isolation_scores(df: DataFrame, features: Sequence[str], forest: list[pd.DataFrame], psi: int,
                     out_col: str = "anomaly_score") -> DataFrame:
    """Anomaly score 2^(−E[h(x)] / c(psi)) per row (rows with NULL features get NULL)."""
    features = list(features)
    cn = _c(psi)
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(_stack(forest))
    schema = StructType([*df.schema.fields, StructField(out_col, DoubleType())])
    def score(batches):
        trees = bc.value
        for pdf in batches:
            X = pdf[features].to_numpy(dtype=np.float64)
            ok = ~np.isnan(X).any(axis=1)
            s = np.full(len(pdf), np.nan)
            if ok.any():
                s[ok] = np.power(2.0, -_path_lengths(X[ok], trees) / cn)
            pdf[out_col] = s
            yield pdf

    return df.mapInPandas(score, schema)


def isolation_forest_flag(df: DataFrame, features: Sequence[str], out_col: str = "is_outlier",
                          contamination: float = 0.05, trees: int = 100, psi: int = 256, seed: int = 42,
                          key: str | None = None) -> DataFrame:
    """Boolean ``out_col``: score above the exact (1 − contamination) quantile of all scores."""
    forest, psi_eff = fit_isolation_forest(df, features, key, trees, psi, seed)
    # scores feed both the cut-off and the flag: materialise them once in the shared checkpoint folder
    scored = cut_lineage(isolation_scores(df, features, forest, psi_eff, "_iso_score"))
    cut = exact_quantiles(scored.select((-F.col("_iso_score")).alias("ns")), "ns", [contamination], names=["off"]).first()
    off = cut["off"] if cut is not None else None
    flag = F.coalesce(-F.col("_iso_score") < F.lit(off), F.lit(False)) if off is not None else F.lit(False)
    return scored.withColumn(out_col, flag).drop("_iso_score")
