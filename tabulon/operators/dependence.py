"""Correlation and dependence.

Kendall's tau-b is computed exactly without emitting pairs: the count of
concordant pairs is split into (1) pairs in different x- and y-range
buckets, answered from a bucket-grid 2-D prefix sum, (2) pairs sharing a
y-bucket and (3) pairs sharing an x-bucket, each answered inside its bucket
by a bitwise merge count over the *distinct cells* of that bucket.
Values that equal a split point form their own bucket, so a hot value can
never make a bucket large: a bucket holding a single x (or y) value has no
pairs to count and is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions.exprs import strength_label
from tabulon.operators.stats import pearson_matrix, spearman_matrix, with_corr_pvalues
from tabulon.plans.ordering import global_positions, quantiles_of, range_splits, running_totals
from tabulon.session import cut_lineage, shuffle_partitions


# ---------------------------------------------------------------- #46
def first_appearance_codes(df: DataFrame, col: str, order_col: str, out: str) -> DataFrame:
    """Integer code per level of ``col`` in order of first appearance (0-based).

    One row per level (grouped ``min`` of the order key, of any type) is numbered by ranges, then joined back on the level.
    """
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_col).alias("_first"))
    codes = global_positions(firsts, [F.col("_first"), F.col(col)], out).drop("_first")
    return df.join(codes, on=col, how="left")


def correlation_frame(df: DataFrame, numeric: Sequence[str], binary: Sequence[str],
                      ratios: dict[str, tuple[str, str]], code_col: str | None = None,
                      order_col: str | None = None, code_name: str = "State_Code") -> DataFrame:
    """Select the analysis columns: numeric, 0/1 flags, ratios (NULL on zero denominators), and a code."""
    cols = [F.col(c).cast("double").alias(c) for c in [*numeric, *binary]]
    cols += [F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).alias(n) for n, (a, b) in ratios.items()]
    keep = [F.col(code_col)] if code_col else []
    keep += [F.col(order_col)] if order_col else []
    out = df.select(*keep, *cols)
    if code_col:
        out = first_appearance_codes(out, code_col, order_col, code_name).drop(code_col)
        out = out.withColumn(code_name, F.col(code_name).cast("double"))
    return out.drop(order_col) if order_col else out


# ---------------------------------------------------------------- #47, #48
def pearson_with_p(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    return with_corr_pvalues(pearson_matrix(df, cols), "r", alpha)


def spearman_with_p(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    return with_corr_pvalues(spearman_matrix(df, cols), "rho", alpha)


# ---------------------------------------------------------------- #49 Kendall tau-b
def _split_bucket(v, splits: list[float]):
    """Bucket id with split values isolated: 2k+1 for v == s_k, 2k for the open interval below s_k."""
    if not splits:
        return F.lit(0)
    arr = F.array(*[F.lit(float(s)) for s in splits])
    below = F.size(F.filter(arr, lambda s: s < v))
    hit = F.exists(arr, lambda s: s == v)
    return F.when(hit, below * 2 + 1).otherwise(below * 2)


def dominance(order_key: np.ndarray, rank_key: np.ndarray, w: np.ndarray) -> float:
    """sum_j w_j * sum_{i: order_i < order_j, rank_i < rank_j} w_i (strict in both), O(m log m) in whole arrays.

    Rows stand by order; the ranks' bits part them from the highest down.  Two ranks first differ at one bit, so on that
    level, inside the group that shares the higher bits, every row with a 1 counts the rows with a 0 of lesser order.
    """
    if len(w) < 2:
        return 0.0
    _, o = np.unique(order_key, return_inverse=True)
    _, r = np.unique(rank_key, return_inverse=True)
    at = np.argsort(o, kind="stable")
    o, r, w = o[at], r[at], np.asarray(w, np.float64)[at]
    total, place = 0.0, np.arange(len(w))
    for level in reversed(range(int(r.max()).bit_length())):
        group, one = r >> (level + 1), (r >> level) & 1
        zeros = np.where(one == 0, w, 0.0)
        before = np.cumsum(zeros) - zeros
        fresh = np.append(True, group[1:] != group[:-1])
        block = fresh | np.append(True, o[1:] != o[:-1])
        since = lambda starts: before[np.maximum.accumulate(np.where(starts, place, 0))]  # noqa: E731, B023
        total += float((w * one * (since(block) - since(fresh))).sum())
        at = np.argsort((group << 1) | one, kind="stable")
        o, r, w = o[at], r[at], w[at]
    return total


def _local_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within-bucket dominance count for one bucket (applyInPandas body)."""
    val = dominance(pdf["o"].to_numpy(), pdf["r"].to_numpy(), pdf["w"].to_numpy(dtype=np.float64))
    return pd.DataFrame({"pair_id": [int(pdf["pair_id"].iloc[0])], "part": [float(val)]})


#: Distinct cells that a bucket holds about, and the most buckets a side (the grid has ``(2B + 1)^2`` cells at most).
BUCKET_CELLS, MOST_BUCKETS = 100_000, 1024


def kendall_tau_b(df: DataFrame, pairs: Sequence[tuple[str, str]], n_buckets: int | None = None) -> DataFrame:
    """Exact Kendall tau-b for each (x, y) pair, with the tie-corrected asymptotic z.

    Columns: var1, var2, n, tau_b, s (concordant − discordant), z.  The number of buckets follows from the number of distinct
    cells: about ``BUCKET_CELLS`` to a bucket, which one task counts in whole arrays; beyond ``MOST_BUCKETS`` buckets they grow.
    """
    results = []
    for pid, (xc, yc) in enumerate(pairs):
        base = df.select(F.col(xc).cast("double").alias("x"), F.col(yc).cast("double").alias("y"))
        base = base.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
        cells = cut_lineage(base.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))  # reused by every term
        buckets = n_buckets or min(MOST_BUCKETS, max(2 * shuffle_partitions(df.sparkSession), -(-cells.count() // BUCKET_CELLS)))
        xs = range_splits(cells, "x", buckets)
        ys = range_splits(cells, "y", buckets)
        cells = cells.withColumns({"bx": _split_bucket(F.col("x"), xs), "by": _split_bucket(F.col("y"), ys),
                                   "pair_id": F.lit(pid).cast("long")})
        t1 = _grid_term(cells, 2 * len(xs) + 1, 2 * len(ys) + 1)
        # same y-bucket, lower x-bucket: sweep each y-bucket ordered by y, ranked by x-bucket.
        # Odd buckets hold one split value only (no strictly-ordered pairs) and are skipped.
        same_y = (cells.where(F.col("by") % 2 == 0)
                  .select("pair_id", "by", F.col("y").alias("o"), F.col("bx").cast("double").alias("r"), "w")
                  .groupBy("pair_id", "by").applyInPandas(_local_counts, "pair_id long, part double"))
        # same x-bucket: sweep each x-bucket ordered by x, ranked by y
        same_x = (cells.where(F.col("bx") % 2 == 0)
                  .select("pair_id", "bx", F.col("x").alias("o"), F.col("y").alias("r"), "w")
                  .groupBy("pair_id", "bx").applyInPandas(_local_counts, "pair_id long, part double"))
        conc = t1.unionByName(same_y).unionByName(same_x).agg(F.sum("part").alias("conc"))

        def tie_stats(t: DataFrame, p: str) -> DataFrame:
            t = t.withColumn("t", F.col("t").cast("double"))
            return t.agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"{p}_pairs"),
                         F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias(f"{p}_v"),
                         F.sum(F.col("t") * (F.col("t") - 1)).alias(f"{p}_v1"),
                         F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias(f"{p}_v2"),
                         F.sum(F.col("t") ** 2).alias(f"{p}_sq"))

        tx = tie_stats(cells.groupBy("x").agg(F.sum("w").alias("t")), "x")
        ty = tie_stats(cells.groupBy("y").agg(F.sum("w").alias("t")), "y")
        # pairs tied in y but not in x: per y value, (u^2 - sum_x w^2) / 2
        yx = (cells.groupBy("y").agg(((F.sum("w").cast("double") ** 2 - F.sum(F.col("w").cast("double") ** 2)) / 2)
                                     .alias("q")).agg(F.sum("q").alias("ytie_xdiff")))
        tot = cells.agg(F.sum("w").cast("double").alias("n"))
        parts = [tot, tx, ty, yx, conc]
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionByName(p, allowMissingColumns=True)
        one = stacked.agg(*[F.max(c).alias(c) for c in
                            ["n", "conc", "ytie_xdiff"] + [f"{a}_{b}" for a in "xy" for b in ("pairs", "v", "v1", "v2", "sq")]])
        n = F.col("n")
        n0 = n * (n - 1) / 2
        lt_x = (n * n - F.col("x_sq")) / 2               # pairs with x_i < x_j
        disc = lt_x - F.col("conc") - F.col("ytie_xdiff")
        s = F.col("conc") - disc
        denom = F.sqrt((n0 - F.col("x_pairs")) * (n0 - F.col("y_pairs")))
        var = ((n * (n - 1) * (2 * n + 5) - F.col("x_v") - F.col("y_v")) / 18
               + F.col("x_v1") * F.col("y_v1") / (2 * n * (n - 1))
               + F.col("x_v2") * F.col("y_v2") / (9 * n * (n - 1) * (n - 2)))
        results.append(one.select(F.lit(xc).alias("var1"), F.lit(yc).alias("var2"), n.cast("long").alias("n"),
                                  F.try_divide(s, denom).alias("tau_b"), s.alias("s"),
                                  F.try_divide(s, F.sqrt(var)).alias("z")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _grid_term(cells: DataFrame, nbx: int, nby: int) -> DataFrame:
    """sum over cells c of w_c * #points in buckets strictly below c in both x and y.

    Dense 2-D exclusive prefix over the bucket grid (``nbx * nby`` rows, fixed by
    the bucket count): running sum over y-buckets within each x-bucket, then over
    x-buckets within each y-bucket.
    """
    spark = cells.sparkSession
    hist = cells.groupBy("bx", "by").agg(F.sum("w").alias("h"))
    dense = spark.range(nbx * nby).select((F.col("id") / nby).cast("int").alias("bx"),
                                          (F.col("id") % nby).cast("int").alias("by"))
    grid = dense.join(hist, ["bx", "by"], "left").na.fill(0, ["h"])
    wy = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("hy", F.coalesce(F.sum("h").over(wy), F.lit(0)))
    wx = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    pref = grid.select("bx", "by", F.coalesce(F.sum("hy").over(wx), F.lit(0)).alias("p"))
    weighted = cells.groupBy("pair_id", "bx", "by").agg(F.sum("w").alias("wc"))
    return (weighted.join(pref, ["bx", "by"], "inner")
            .groupBy("pair_id").agg(F.sum(F.col("wc") * F.col("p")).cast("double").alias("part")))


def with_kendall_pvalues(taus: DataFrame, alpha: float = 0.05) -> DataFrame:
    return (taus.withColumn("p_value", special.z_pvalue(F.col("z")))
            .withColumn("significant", F.col("p_value") < alpha))


# ---------------------------------------------------------------- #50, #51
def _quantile_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Equal-frequency inner edges (exact, interpolated) of several columns from ONE grouped pass.

    The ``len(cols) * (bins - 1)`` edges are bounded and come to the driver as literals.
    """
    probs = [i / bins for i in range(1, bins)]
    names = [f"e{i}" for i in range(1, bins)]
    rows = quantiles_of(df, cols, probs, names=names).collect()
    return {r["variable"]: [r[n] for n in names if r[n] is not None] for r in rows}


def _code(col: str, edges: list[float]):
    """Right-closed bin code: number of edges strictly below the value."""
    code = F.lit(0)
    for e in edges:
        code = code + F.when(F.col(col) > F.lit(float(e)), 1).otherwise(0)
    return F.when(F.col(col).isNotNull(), code)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10,
                       target_bins: int | None = None) -> DataFrame:
    """Plug-in mutual information (nats) between binned features and a class (or binned numeric) target.

    Re-aimed from a nearest-neighbour estimator: counts over (bin, class)
    cells, so it is a deterministic grouped aggregate.
    """
    base = df.select(*[F.col(c) for c in dict.fromkeys([*features, target])])
    ycode = "_y"
    binned = list(features) + ([target] if target_bins else [])
    edges = _quantile_edges(base, binned, bins) if not target_bins or target_bins == bins else {
        **_quantile_edges(base, list(features), bins), **_quantile_edges(base, [target], target_bins)}
    if target_bins:
        base = base.withColumn(ycode, _code(target, edges.get(target, [])))
    else:
        base = base.withColumn(ycode, F.col(target).cast("string"))
    base = base.withColumns({f"_b{i}": _code(f, edges.get(f, [])) for i, f in enumerate(features)})
    recs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_b{i}").cast("string").alias("xb"))
                     for i, f in enumerate(features)])
    long = (base.select(F.col(ycode).cast("string").alias("yb"), F.explode(recs).alias("r"))
            .select("r.feature", "r.xb", "yb").where(F.col("xb").isNotNull() & F.col("yb").isNotNull()))
    cells = long.groupBy("feature", "xb", "yb").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    cells = cells.withColumns({
        "n": F.sum("nxy").over(wf),
        "nx": F.sum("nxy").over(Window.partitionBy("feature", "xb")),
        "ny": F.sum("nxy").over(Window.partitionBy("feature", "yb")),
    })
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return cells.groupBy("feature").agg(F.sum(term).alias("mutual_info")).withColumn("target", F.lit(target))


# ---------------------------------------------------------------- #53
def partial_correlation(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """First-order partial correlation r_xy.z from three correlations in one aggregate; 0 if undefined."""
    X, Y, Z = (F.col(c).cast("double") for c in (x, y, z))
    one = df.agg(F.corr(X, Y).alias("rxy"), F.corr(X, Z).alias("rxz"), F.corr(Y, Z).alias("ryz"))
    den = F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    pc = F.when(den == 0, F.lit(0.0)).otherwise((F.col("rxy") - F.col("rxz") * F.col("ryz")) / den)
    return one.select(F.lit(x).alias("var1"), F.lit(y).alias("var2"), F.lit(z).alias("control"),
                      "rxy", "rxz", "ryz", pc.alias("partial_r"))


# ---------------------------------------------------------------- #52, #54, #55
def key_pair_significance(df: DataFrame, pairs: Sequence[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """Pearson and Spearman r with p for selected pairs, flags and strength."""
    cols = list(dict.fromkeys([c for p in pairs for c in p]))
    pe = pearson_with_p(df, cols, alpha)
    sp = spearman_with_p(df, cols, alpha)
    keys = F.array(*[F.lit(f"{a}\u0001{b}") for a, b in pairs])
    key = F.concat_ws("\u0001", "var1", "var2")
    pe = pe.where(F.array_contains(keys, key)).select("var1", "var2", "n", F.col("r").alias("pearson_r"),
                                                     F.col("p_value").alias("pearson_p"))
    sp = sp.where(F.array_contains(keys, key)).select("var1", "var2", F.col("rho").alias("spearman_r"),
                                                     F.col("p_value").alias("spearman_p"))
    out = pe.join(sp, ["var1", "var2"])
    return out.withColumns({
        "pearson_significant": F.col("pearson_p") < alpha,
        "spearman_significant": F.col("spearman_p") < alpha,
        "strength": strength_label("pearson_r"),
    })


def strong_pairs(long_with_p: DataFrame, r_col: str, threshold: float = 0.5, alpha: float = 0.05,
                 method: str = "pearson") -> DataFrame:
    """Pairs var1 < var2 (by name) with abs(r) >= threshold and p < alpha; strength and direction."""
    return (long_with_p.where((F.col("var1") < F.col("var2")) & (F.abs(F.col(r_col)) >= threshold)
                              & (F.col("p_value") < alpha))
            .select("var1", "var2", F.col(r_col).alias("r"), "p_value",
                    strength_label(r_col).alias("strength"),
                    F.when(F.col(r_col) > 0, "positive").otherwise("negative").alias("direction"),
                    F.lit(method).alias("method")))


def pattern_summary(strong: DataFrame, top: int = 5) -> DataFrame:
    """Counts by strength and the top-``top`` most connected variables (ties by name)."""
    by_strength = strong.groupBy("strength").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("strength").alias("kind"), F.col("strength").alias("name"), "n")
    conn = (strong.select(F.explode(F.array("var1", "var2")).alias("name")).groupBy("name")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(top)
            .select(F.lit("connected").alias("kind"), "name", "n"))
    return by_strength.unionByName(conn)


# ---------------------------------------------------------------- #56
def correlation_clusters(edges: DataFrame, src: str = "var1", dst: str = "var2") -> DataFrame:
    """Connected components by iterative min-label propagation (re-aimed from a greedy grouping).

    Each round is one distributed join + aggregate; the loop stops when no
    label changes (a one-number action).  Lineage is cut every few rounds.
    """
    und = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    und = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = und.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    i = 0
    while True:
        nb = und.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b")
        cand = nb.groupBy("a").agg(F.min("lb").alias("m"))
        new = (labels.join(cand, labels.node == cand.a, "left")
               .select("node", F.least("label", F.coalesce("m", "label")).alias("label")))
        if i % 4 == 3:
            new = cut_lineage(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels, i = new, i + 1
        if changed == 0:
            break
    return labels.select(F.col("node").alias("variable"), F.col("label").alias("cluster"))
