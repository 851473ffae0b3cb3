"""Feature selection.

Statistics-based selectors (variance, ANOVA F) are single aggregates over the
feature table; model-based selectors grow forests in shared passes or follow a
lasso path on cross-products.  Every selector returns a tidy
``(method, feature, score, selected)`` DataFrame; the vote is a grouped
aggregate over their union.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tabulon.operators import forest as FO
from tabulon.operators.lasso import lasso_path
from tabulon.operators.stats import anova
from tabulon.plans.ordering import quantiles_of

FEATURES = "features"


def _q(c: str):
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- #74
def candidate_features(df: DataFrame, target: str, exclude: Sequence[str] = (),
                       leakage_guard: Sequence[str] = ()) -> list[str]:
    """Numeric (non-boolean) columns except the target, excluded names and target-derived columns."""
    drop = {target, *exclude}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name not in drop:
            if any(tok in f.name for tok in leakage_guard):
                continue
            out.append(f.name)
    return out


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULL/NaN of each column with its exact median; medians are computed only of columns that have missing values."""
    if not cols:
        return df
    x = {c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double")) for c in cols}
    held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(x[c]).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    gaps = [c for i, c in enumerate(cols) if 0 < held[f"c{i}"] < held["n"]]
    med = {r["variable"]: r["median"] for r in quantiles_of(df, gaps, [0.5], names=["median"]).collect()} if gaps else {}
    return df.withColumns({c: F.coalesce(x[c], F.lit(med[c])) if c in med else _q(c).cast("double") for c in cols})


def assemble(df: DataFrame, cols: Sequence[str], target: str | None = None, out: str = FEATURES) -> DataFrame:
    """Vector column of the given features (+ ``label`` double when a target is given)."""
    sanitized = {c: f"f{i}" for i, c in enumerate(cols)}
    base = df.select(*[_q(c).cast("double").alias(sanitized[c]) for c in cols],
                     *([F.col(target).cast("double").alias("label")] if target else []))
    return VectorAssembler(inputCols=list(sanitized.values()), outputCol=out, handleInvalid="keep").transform(base)


# ---------------------------------------------------------------- #75
def variance_threshold(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Population variance per feature; selected when strictly above the threshold."""
    one = df.agg(*[F.var_pop(_q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("score"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")
    return long.select(F.lit("variance").alias("method"), "feature", "score",
                       F.coalesce(F.col("score") > threshold, F.lit(False)).alias("selected"))


# ---------------------------------------------------------------- #76
def f_score_selection(df: DataFrame, cols: Sequence[str], target: str, k: int = 10,
                      percentile: float = 75.0) -> DataFrame:
    """ANOVA F of each feature across target classes; selected if in the top ``k`` or the top ``percentile`` %.

    Ranks are over at most one row per feature (ties by name).
    """
    f = anova(df, target, list(cols)).select(F.col("variable").alias("feature"), F.col("f_statistic").alias("score"))
    n = len(cols)
    keep_pct = int(n * percentile / 100.0)
    keep = max(min(k, n), keep_pct)
    # one row per feature: the unpartitioned window is bounded by the feature count
    ranked = f.withColumn("_rk", F.row_number().over(
        Window.orderBy(F.col("score").desc_nulls_last(), F.col("feature"))))
    return ranked.select(F.lit("f_score").alias("method"), "feature", "score", (F.col("_rk") <= keep).alias("selected"))


# ---------------------------------------------------------------- #77, #78, #83
def _scores_frame(spark, method: str, scores: list[tuple[str, float]], selected: set[str]) -> DataFrame:
    return spark.createDataFrame([(method, f, s, f in selected) for f, s in scores],
                                 "method string, feature string, score double, selected boolean")


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[_q(c) for c in df.columns])


def binned(df: DataFrame, cols: Sequence[str], target: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """The rows of the forests of ``forest_importance`` and ``recursive_elimination``, dealt to folds by hash; where a query
    calls several of these, they can share them."""
    fold = F.pmod(F.xxhash64(_row_hash(df), F.lit(seed)), F.lit(folds))
    keyed = df.select("*", _row_hash(df).alias("_key"), fold.alias("_fold"))
    return FO.packed_rows(keyed, cols, FO.feature_edges(keyed, cols), target, "_key", "_fold")


def forest_importance(df: DataFrame, cols: Sequence[str], target: str, trees: int = 100, seed: int = 42,
                      extra: bool = False, quantile: float | None = None, depth: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Random-forest impurity importance of fully grown trees; keep features above the median (or the given quantile).

    ``extra=True`` are extremely randomised trees: no bootstrap, random thresholds, features above the third quartile.
    ``rows`` are ``binned`` rows of the same table and columns.
    """
    spec = FO.ForestSpec(trees=trees, depth=depth, seed=seed, extra=extra, bootstrap=not extra)
    grown = FO.grow_forests(rows if rows is not None else binned(df, cols, target), [spec], len(cols), kept=())
    scores = sorted((r["feature"], r["importance"]) for r in FO.importances(grown, cols).collect())
    vals = np.array([s for _, s in scores])
    q = quantile if quantile is not None else (75.0 if extra else 50.0)
    cut = float(np.percentile(vals, q)) if len(vals) else 0.0
    return _scores_frame(df.sparkSession, "extra_trees" if extra else "random_forest", scores, {f for f, s in scores if s > cut})


# ---------------------------------------------------------------- #79
def lasso_selection(df: DataFrame, cols: Sequence[str], target: str, folds: int = 5, seed: int = 42, tol: float = 1e-5) -> DataFrame:
    """L1 linear regression of the 0/1 target on features as they are, penalty of 100 chosen by k-fold error (rows are dealt to
    folds by hash); keep abs(coef) > tol."""
    path = lasso_path(df, cols, target, F.pmod(F.xxhash64(_row_hash(df), F.lit(seed)), F.lit(folds)))
    scores = [(c, float(abs(w))) for c, w in zip(cols, path["coefficients"], strict=True)]
    return _scores_frame(df.sparkSession, "lasso", scores, {f for f, s in scores if s > tol})


# ---------------------------------------------------------------- #80
def recursive_elimination(df: DataFrame, cols: Sequence[str], target: str, min_features: int = 5, step: int = 1,
                          folds: int = 3, trees: int = 50, seed: int = 42, depth: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Backward elimination by the importance of fully grown forests, scored by k-fold CV accuracy at every size.

    The loop runs on the driver over feature *names* only (bounded by the feature count).  Rows are binned once; at every
    size the forest on all rows and those of the folds are grown together.  ``rows`` are ``binned`` rows of the same table,
    columns, folds and seed.  Returns (method, feature, score = elimination rank, selected).
    """
    cols = list(cols)
    rows = rows if rows is not None else binned(df, cols, target, folds, seed)
    active = list(range(len(cols)))
    ranking: dict[int, int] = {}
    history: list[tuple[list[int], float]] = []
    while True:
        specs = [FO.ForestSpec(trees=trees, depth=depth, seed=seed, features=tuple(active), without_fold=k) for k in (None, *range(folds))]
        grown, scores = FO.grow_and_score(rows, specs, len(cols))
        right = FO.held_out_accuracy(rows, scores, specs, len(cols))
        history.append((list(active), float(np.mean(list(right.values()) or [0.0]))))
        if len(active) <= min_features:
            break
        score = {int(r["feature"]): r["importance"] for r in FO.importances(grown.where("fit = 0"), [str(a) for a in active]).collect()}
        order = sorted(active, key=lambda i: (score[i], cols[i]))
        drop = order[:min(step, len(active) - min_features)]
        for d in drop:
            ranking[d] = len(active)
        active = [a for a in active if a not in drop]
    best, _ = max(history, key=lambda h: (h[1], -len(h[0])))
    for a in best:
        ranking[a] = 1
    scores = [(c, float(ranking.get(i, 1))) for i, c in enumerate(cols)]
    return _scores_frame(df.sparkSession, "rfe", scores, {cols[i] for i in best})


# ---------------------------------------------------------------- #81–#83
def vote(variance: DataFrame, statistical: DataFrame, model_based: DataFrame, rfe: DataFrame,
         rf_scores: DataFrame, min_votes: int = 2, fallback_top: int = 15, min_selected: int = 10,
         cap: int = 25) -> DataFrame:
    """Features passing the variance filter with ≥ ``min_votes`` of (statistical, model-based, RFE).

    If fewer than ``min_selected`` pass, the top RF features of those are added.  The
    cap keeps the best by (votes, RF importance, name) — a deterministic order
    where the reference takes an arbitrary subset.
    """
    base = variance.where("selected").select("feature")
    ballots = (statistical.where("selected").select("feature", F.lit("statistical").alias("m"))
               .unionByName(model_based.where("selected").select("feature", F.lit("model").alias("m")))
               .unionByName(rfe.where("selected").select("feature", F.lit("rfe").alias("m"))))
    votes = ballots.groupBy("feature").agg(F.countDistinct("m").alias("votes"))
    rf = rf_scores.select("feature", F.col("score").alias("rf_importance"))
    table = base.join(votes, "feature", "left").na.fill(0, ["votes"]).join(rf, "feature", "left")
    passed = table.where(F.col("votes") >= min_votes)
    if passed.count() < min_selected:
        # only features that passed the variance filter can come back
        top = table.orderBy(F.col("rf_importance").desc_nulls_last(), "feature").limit(fallback_top)
        passed = passed.unionByName(top.select(*passed.columns)).dropDuplicates(["feature"])
    return (passed.orderBy(F.col("votes").desc(), F.col("rf_importance").desc_nulls_last(), "feature")
            .limit(cap))


def model_based_union(*frames: DataFrame) -> DataFrame:
    """A feature is model-selected when any model-based method selects it."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.groupBy("feature").agg(F.max(F.col("selected").cast("int")).cast("boolean").alias("selected")) \
        .select(F.lit("model_based").alias("method"), "feature", F.lit(None).cast("double").alias("score"), "selected")


def project_selected(df: DataFrame, selected: Sequence[str], essential: Sequence[str]) -> DataFrame:
    """Selected features plus essential columns, first occurrence order, no duplicates."""
    cols = list(dict.fromkeys([*selected, *essential]))
    return df.select(*[_q(c) for c in cols if c in df.columns])


def passing(variance: DataFrame) -> list[str]:
    """Names of the features that passed the variance filter (at most the number of candidates); all later selectors see
    these alone."""
    return [r["feature"] for r in variance.where("selected").orderBy("feature").collect()]


def importance_lookup(scores: DataFrame, method: str) -> DataFrame:
    return scores.where(F.col("method") == method).orderBy(F.col("score").desc(), "feature")


def selection_report(frames: dict[str, DataFrame], final: DataFrame, rf_scores: DataFrame, top: int = 10) -> DataFrame:
    """(section, name, value) rows: counts per method, final features, top RF features (#7)."""
    parts = [f.where("selected").agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select(F.lit("count").alias("section"), F.lit(m).alias("name"), "value") for m, f in frames.items()]
    parts.append(final.select(F.lit("final").alias("section"), F.col("feature").alias("name"),
                              F.col("votes").cast("double").alias("value")))
    parts.append(rf_scores.orderBy(F.col("score").desc(), "feature").limit(top)
                 .select(F.lit("top_random_forest").alias("section"), F.col("feature").alias("name"),
                         F.col("score").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

