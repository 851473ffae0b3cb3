"""Model training, ensembles, tuning and scoring.

Built on ``pyspark.ml`` and ``forest``: every fit is a distributed job over a DataFrame of
(``features`` vector, ``label``).  Ensembles combine the probability
vectors of the member models column-wise; stacking uses deterministic
hash-based folds so out-of-fold scores are reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import forest as FO
from tabulon.operators.boosted import BinnedBoosting
from tabulon.operators.ensemble import StackedModel, VotingModel, fit_rbf_svm, member_probabilities, save_model, side_by_side  # noqa: F401
from tabulon.operators.search import search_forest
from tabulon.plans.ordering import running_totals
from tabulon.session import by_key, cut_lineage

FEATURES = "features"


# ---------------------------------------------------------------- #84
def test_sizes(sizes: dict, test_fraction: float) -> dict:
    """Rows of each class that go to test: ``ceil(test_fraction * n)`` in all, by largest remainder (ties by class size,
    then in the order given)."""
    n = sum(sizes.values())
    total = math.ceil(test_fraction * n - 1e-9)
    exact = {k: v * total / n for k, v in sizes.items()}
    out = {k: int(x + 1e-9) for k, x in exact.items()}
    for k in sorted(sizes, key=lambda k: (out[k] - exact[k], -sizes[k]))[:total - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Deterministic stratified split by ``xxhash64(key, seed)``: of each class the rows of smallest hash go to test.

    No row moves.  Rows are counted by class and the hash's top 16 bits; only the rows of the one prefix per class that
    holds the cut are ranked, and the split itself is a comparison with the class's cut hash.  Rows that share a key stay
    on one side.  Few classes are expected: one row for each is collected.  Null is a class of its own.
    """
    lab, h = F.col(f"`{label}`"), F.xxhash64(F.col(f"`{key}`"), F.lit(seed))
    hashed = df.select(lab.alias("label"), h.alias("h"), F.shiftright(h, 48).alias("prefix"))
    counts = hashed.groupBy("label", "prefix").agg(F.count(F.lit(1)).alias("n"))
    # at most 65,536 prefixes to a class
    counts = cut_lineage(counts.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("prefix"))))
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()}
    wanted = test_sizes(sizes, test_fraction) if sizes else {}
    of = lambda col, values: F.coalesce(*[F.when(col.eqNullSafe(F.lit(k)), F.lit(v)) for k, v in values.items()], F.lit(None))
    cuts: dict = {}
    if wanted:
        held = counts.withColumn("want", of(F.col("label"), wanted)).where("upto >= want and upto - n < want and want > 0")
        held = held.select(F.col("label").alias("_l"), F.col("prefix").alias("_p"), (F.col("want") - F.col("upto") + F.col("n")).alias("place"))
        ranked = hashed.join(F.broadcast(held), F.col("label").eqNullSafe(F.col("_l")) & (F.col("prefix") == F.col("_p")))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h")))
        cuts = {r["label"]: r["h"] for r in ranked.where("rank = place").collect()}
    test = F.coalesce(h <= of(lab, cuts).cast("long"), F.lit(False)) if cuts else F.lit(False)
    return df.where(~test), df.where(test)


def feature_frame(df: DataFrame, cols: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., features vector, label double)."""
    names = [f"f{i}" for i in range(len(cols))]
    base = df.select(*[F.col(k) for k in keep], *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)],
                     *([F.col(label).cast("double").alias("label")] if label else []))
    return VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep").transform(base).drop(*names)


# ---------------------------------------------------------------- #85–#89
def random_forest(trees: int = 100, depth: int = 10, min_split: int = 5, seed: int = 42, key: str = "row_key") -> FO.Forest:
    """Bootstrap forest over sqrt feature subsets, ``depth`` levels, nodes below ``min_split`` rows left whole; draws are hashes
    of ``key``."""
    return FO.Forest(FO.ForestSpec(trees=trees, depth=depth, min_split=min_split, seed=seed), key, whole=True)


def gradient_boosting(iters: int = 100, step: float = 0.1, depth: int = 6, seed: int = 42) -> BinnedBoosting:
    return BinnedBoosting(GBTClassifier(featuresCol="_bins", labelCol="label", weightCol="_rows", maxIter=iters, stepSize=step, maxDepth=depth, seed=seed))


def logistic_regression(n_rows: int, max_iter: int = 1000, c: float = 1.0) -> LogisticRegression:
    """L2 logistic regression; ``regParam = 1 / (C * n)`` matches an unscaled-C penalty on the summed loss."""
    return LogisticRegression(featuresCol=FEATURES, labelCol="label", maxIter=max_iter,
                              regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False)


def extra_trees(trees: int = 100, seed: int = 42, depth: int | None = None) -> FO.Forest:
    """Extremely randomised trees: no bootstrap, sqrt feature subsets, one random threshold a feature, grown until leaves are
    pure (or ``depth`` levels)."""
    return FO.Forest(FO.ForestSpec(trees=trees, depth=depth, extra=True, bootstrap=False, seed=seed))


# ---------------------------------------------------------------- #90, #91
def positive_probability(scored: DataFrame, out: str) -> DataFrame:
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


def soft_vote(models: dict, df: DataFrame, key: str) -> DataFrame:
    """Mean positive-class probability of the member models; prediction = argmax (> 0.5)."""
    probs = [F.col(f"p_{n}") for n in models]
    mean = sum(probs[1:], probs[0]) / len(probs)
    return (member_probabilities(models, df).withColumn("score", mean)
            .withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop(*[f"p_{n}" for n in models]))


def fold_column(df: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Stratified deterministic fold id: rank within class by hash, then round-robin over folds."""
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed + 1)).cast("double")).withColumn("_one", F.lit(1))
    rt = running_totals(h, "_h", ["_one"], by=[label], tiebreak=[F.col(key).asc()])
    return rt.withColumn("fold", ((F.col("_one_cum") - 1) % folds).cast("int")).drop("_h", "_one", "_one_cum", "_one_total")


def stacking(train: DataFrame, test: DataFrame | None, bases: dict, key: str, folds: int = 5, seed: int = 42):
    """Out-of-fold base probabilities → logistic-regression meta model; bases refit on all rows.

    A base is a ``ForestSpec``, or a function that makes an estimator.  All forests, those of every fold and those on all rows,
    are grown together; the other fits run side by side.  Returns (test scored with ``score``/``prediction``, the
    ``StackedModel``, its meta model), or the model alone where there is no ``test``.
    """
    tf = by_key(fold_column(train, "label", key, folds, seed), key)   # every fit reads this table
    forests = {n: b for n, b in bases.items() if isinstance(b, FO.ForestSpec)}
    parts, models = [], {}
    if forests:
        wide, cols = FO.vector_columns(tf)
        edges = FO.feature_edges(wide, cols)
        rows = FO.packed_rows(wide, cols, edges, "label", key, "fold")
        specs = [replace(s, without_fold=k) for s in forests.values() for k in (*range(folds), None)]
        trees, scores = FO.grow_and_score(rows, specs, len(cols), kept=[i for i, x in enumerate(specs) if x.without_fold is None])
        name = F.element_at(F.array(*[F.lit(n) for n in forests for _ in range(folds + 1)]), F.col("fit") + 1)
        held = FO.held_out_rows(rows, scores, specs, len(cols))
        parts.append(held.select(F.col("key").alias(key), name.alias("base"), "p"))
        models |= {n: FO.ForestModel.of(trees.where(F.col("fit") == i * (folds + 1) + folds), edges) for i, n in enumerate(forests)}
    others = [(n, k) for n in bases if n not in forests for k in (*range(folds), None)]
    for (n, k), fitted in zip(others, side_by_side([lambda n=n, k=k: bases[n]().fit(tf if k is None else tf.where(F.col("fold") != k))
                                                    for n, k in others]) if others else [], strict=True):
        if k is None:
            models[n] = fitted
        else:
            out = fitted.transform(tf.where(F.col("fold") == k))
            parts.append(out.select(key, F.lit(n).alias("base"), vector_to_array(F.col("probability"))[1].alias("p")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    names = [f"p_{n}" for n in bases]
    oof = long.groupBy(key).agg(*[F.max(F.when(F.col("base") == n, F.col("p"))).alias(f"p_{n}") for n in bases])
    meta_in = VectorAssembler(inputCols=names, outputCol="meta").transform(oof.join(tf.select(key, "label"), key))
    meta = LogisticRegression(featuresCol="meta", labelCol="label", maxIter=1000).fit(cut_lineage(meta_in.select("meta", "label")))
    stacked = StackedModel({n: models[n] for n in bases} | {"meta": meta})
    if test is None:
        return stacked
    return positive_probability(stacked.transform(test), "score").select(key, "label", "score", "prediction"), stacked, meta


# ---------------------------------------------------------------- #92, #99
def tune_random_forest(train: DataFrame, folds: int = 3, seed: int = 42, fits: int = 30, key: str = "row_key",
                       first: int = 10) -> tuple[DataFrame, FO.ForestModel]:
    """Model-based search (``search.search_forest``) scored by k-fold accuracy, folds stratified by label.

    Returns the tried points (``point, trees, depth, min_split, min_leaf, max_features, cv_accuracy, model_based``) and the
    best point's forest on all rows.
    """
    tf = by_key(fold_column(train, "label", key, folds, seed), key)
    wide, cols = FO.vector_columns(tf)
    edges = FO.feature_edges(wide, cols)
    rows = FO.binned_rows(wide, cols, edges, "label", key, "fold")
    tried, best = search_forest(rows, len(cols), folds, fits, first, seed=seed)
    model = FO.ForestModel.of(FO.grow_forests(rows, [best], len(cols)), edges)
    table = [(i, *t["point"][:4], t["point"][4] or "all", t["score"], t["model_based"]) for i, t in enumerate(tried)]
    return train.sparkSession.createDataFrame(table, "point long, trees long, depth long, min_split long, min_leaf long, max_features string, "
                                                     "cv_accuracy double, model_based boolean"), model


def cross_val_scores(estimator, data: DataFrame, folds: int = 3, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Accuracy of each fold (``fold`` 0 and up) with the mean and population sd over folds, which are stratified by label."""
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    parts = by_key(fold_column(data, "label", key, folds, seed), key)
    scores = [float(ev.evaluate(estimator.fit(parts.where(F.col("fold") != k)).transform(parts.where(F.col("fold") == k)))) for k in range(folds)]
    mean, sd = float(np.mean(scores)), float(np.std(scores))
    return data.sparkSession.createDataFrame([(k, x, mean, sd) for k, x in enumerate(scores)],
                                             "fold long, accuracy double, cv_mean double, cv_std double")


def train_models(train: DataFrame, key: str, n_features: int, folds: int = 5, svm: dict | None = None) -> dict:
    """The seven models of the comparison by name, in the order in which ties are broken.  Forests of the stack grow together;
    independent fits run side by side."""
    n = train.count()
    names = ["random_forest", "gradient_boosting", "svm", "logistic_regression", "extra_trees"]
    fits = [lambda: random_forest().fit(train), lambda: gradient_boosting().fit(train), lambda: fit_rbf_svm(train, n_features, **(svm or {})),
            lambda: logistic_regression(n).fit(train), lambda: extra_trees().fit(train)]
    stack = {"rf": FO.ForestSpec(trees=50), "gb": lambda: gradient_boosting(iters=50, depth=3),
             "et": FO.ForestSpec(trees=50, extra=True, bootstrap=False)}
    *base, stacked = side_by_side([*fits, lambda: stacking(train, None, stack, key, folds)])
    models = dict(zip(names, base, strict=True))
    models["voting_classifier"] = VotingModel({k: models[k] for k in ("random_forest", "gradient_boosting", "logistic_regression")})
    models["stacking_classifier"] = stacked
    return models


# ---------------------------------------------------------------- #98, #103, #4
def feature_importance(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, or absolute coefficients for linear models, paired with feature names."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        vals = np.abs(model.coefficients.toArray())
    return sorted(zip(names, map(float, vals)), key=lambda t: (-t[1], t[0]))


def predict(model, df: DataFrame) -> DataFrame:
    """Batch scoring with a fitted model/pipeline: adds prediction and positive-class score."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = positive_probability(out, "score")
    return out


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
