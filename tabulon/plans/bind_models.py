"""Bindings for feature selection (#74–#83) and modelling (#4, #84–#92, #98, #99, #103).

Task: predict ``l_returnflag = 'R'`` from lineitem measures and their pairwise
interactions; embeddings → label as a second, vector-valued task.  Model
outputs are random-seeded fits, so apart from the split counts and the
statistical selectors these are rows-only checks.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulon.operators import evaluate as V
from tabulon.operators import forest as FO
from tabulon.operators import models as M
from tabulon.operators import select as SEL
from tabulon.plans.registry import Query, register, table, union_all
from tabulon.session import by_key, checkpoint_dir, cut_lineage

BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
INTER = {"qty_discount": ("l_quantity", "l_discount"), "qty_tax": ("l_quantity", "l_tax"),
         "discount_tax": ("l_discount", "l_tax")}
FEATS = BASE + list(INTER)


def lineitem_task(s, d):
    li = table(s, d, "lineitem")
    return li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_key"), *BASE,
                     *[(F.col(a) * F.col(b)).alias(n) for n, (a, b) in INTER.items()],
                     (F.col("l_returnflag") == "R").cast("double").alias("label"))


TASK_SQL = ("(SELECT " + ", ".join(BASE) + ", " + ", ".join(f"{a} * {b} AS {n}" for n, (a, b) in INTER.items())
            + ", CAST(l_returnflag = 'R' AS DOUBLE) AS label FROM lineitem)")


def split_frames(s, d):
    task = by_key(lineitem_task(s, d), "row_key")   # every fit of the query reads it
    train, test = M.stratified_split(task, "label", "row_key", 0.2, 42)
    return M.feature_frame(train, FEATS, "label", keep=["row_key"]), M.feature_frame(test, FEATS, "label", keep=["row_key"])


def _metrics(model, test, name):
    # the metrics read the scores several times; a forest scores its rows once
    scored = cut_lineage(M.predict(model, test).select("label", "prediction", "score"))
    m = V.classification_metrics(scored, score="score")
    return m.select(F.lit(name).alias("model"), *m.columns)


# ------------------------------------------------------------------ #84
def _split_counts(s, d):
    task = lineitem_task(s, d)
    train, test = M.stratified_split(task, "label", "row_key", 0.2, 42)
    return (train.select("label", F.lit("train").alias("split"))
            .unionByName(test.select("label", F.lit("test").alias("split")))
            .groupBy("label", "split").agg(F.count(F.lit(1)).alias("count")))


register(Query("stratified_split_counts_lineitem", _split_counts,
               f"""WITH c AS (SELECT label, count(*) n FROM {TASK_SQL} GROUP BY 1),
                   t AS (SELECT label, n, n * ceil(sum(n) OVER () * 0.2) / sum(n) OVER () AS want, ceil(sum(n) OVER () * 0.2) AS total FROM c),
                   f AS (SELECT *, row_number() OVER (ORDER BY want - floor(want) DESC, n DESC) AS rk,
                                total - sum(floor(want)) OVER () AS spare FROM t),
                   g AS (SELECT label, n, CAST(floor(want) AS BIGINT) + CAST(rk <= spare AS BIGINT) AS k FROM f)
                   SELECT label, 'test' AS split, k AS count FROM g UNION ALL SELECT label, 'train', n - k FROM g""",
               dbl=("label",), ints=("count",), operators=(84,)))


# ------------------------------------------------------------------ #85–#92
def _fit_eval(make, name):
    def run(s, d):
        train, test = split_frames(s, d)
        return _metrics(make(train).fit(train) if callable(make) else make.fit(train), test, name)
    return run


register(Query("random_forest_lineitem", _fit_eval(lambda t: M.random_forest(), "random_forest"), None,
               operators=(85, 93)))
register(Query("gradient_boosting_lineitem", _fit_eval(lambda t: M.gradient_boosting(), "gradient_boosting"), None,
               operators=(86, 93)))
register(Query("logistic_regression_lineitem",
               _fit_eval(lambda t: M.logistic_regression(t.count()), "logistic_regression"), None, operators=(88, 93)))
register(Query("extra_trees_lineitem", _fit_eval(lambda t: M.extra_trees(), "extra_trees"), None, operators=(89, 93)))


def _svm(s, d):
    train, test = split_frames(s, d)
    model = M.fit_rbf_svm(train, len(FEATS))
    return _metrics(model, test, "svm_rbf")


register(Query("svm_rbf_lineitem", _svm, None, operators=(87, 93)))


def _voting(s, d):
    train, test = split_frames(s, d)
    n = train.count()
    made = {"rf": M.random_forest(), "gb": M.gradient_boosting(), "lr": M.logistic_regression(n)}
    models = dict(zip(made, M.side_by_side([lambda e=e: e.fit(train) for e in made.values()]), strict=True))
    voted = cut_lineage(M.soft_vote(models, test, "row_key").select("label", "prediction", "score"))
    return V.classification_metrics(voted, score="score").select(F.lit("voting").alias("model"), "*")


register(Query("soft_voting_lineitem", _voting, None, operators=(90, 93)))


def _stacking(s, d):
    train, test = split_frames(s, d)
    # stacking members: 50 trees each, forests fully grown; the boosted member at the common library default depth 3
    bases = {"rf": FO.ForestSpec(trees=50), "gb": lambda: M.gradient_boosting(iters=50, depth=3),
             "et": FO.ForestSpec(trees=50, extra=True, bootstrap=False)}
    out, _, _ = M.stacking(train, test, bases, "row_key", folds=5)
    return V.classification_metrics(cut_lineage(out), score="score").select(F.lit("stacking").alias("model"), "*")


register(Query("stacking_lineitem", _stacking, None, operators=(91, 93)))


def _tuning(s, d):
    """Ten random and twenty model-based points, each fitted and scored by 3 folds on all training rows."""
    train, test = split_frames(s, d)
    tried, best = M.tune_random_forest(train, folds=3, fits=30, key="row_key")
    top = tried.agg(F.max("cv_accuracy").alias("cv_best"), F.max(F.when(~F.col("model_based"), F.col("cv_accuracy"))).alias("cv_best_random")).first()
    return (_metrics(best, test, "tuned_random_forest")
            .withColumns({"cv_best": F.lit(top["cv_best"]), "cv_best_random": F.lit(top["cv_best_random"])}))


register(Query("tuned_random_forest_lineitem", _tuning, None, operators=(92,)))


def _compare(s, d):
    """Train the seven models, evaluate them on the held-out rows, compare, recommend and choose; the best by accuracy is
    saved, loaded by name and predicts the held-out rows (#4, #90, #91, #99–#103, #119)."""
    from tabulon.operators import ensemble as EN
    train, test = split_frames(s, d)
    models = M.train_models(train, "row_key", len(FEATS))
    chosen = cut_lineage(EN.choose(EN.evaluate_models(models, test)))
    best = chosen.where("section = 'best' AND name = 'accuracy'").first()["model"]
    folder = f"{checkpoint_dir(s).rstrip('/')}/models/{uuid.uuid4().hex}"
    EN.save_model(models[best], f"{folder}/{best}")
    again = EN.predict_by_name(s, folder, best, test)
    right = again.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("value"))
    return chosen.unionByName(right.select(F.lit("predicted_by_name").alias("section"), F.lit("accuracy").alias("name"),
                                           F.lit(best).alias("model"), "value"))


register(Query("compare_models_lineitem", _compare, None, dbl=("value",), operators=(4, 90, 91, 93, 100, 101, 102, 103, 119)))


def _cv(s, d):
    train, _ = split_frames(s, d)
    return M.cross_val_scores(M.logistic_regression(train.count()), train, folds=3)


register(Query("cross_val_scores_lineitem", _cv, None, operators=(99,)))


def _importance(s, d):
    train, _ = split_frames(s, d)
    model = M.random_forest().fit(train)
    rows = M.feature_importance(model, FEATS)
    return s.createDataFrame(rows, "feature string, importance double")


register(Query("feature_importance_lineitem", _importance, None, operators=(98,)))


def _predict_saved(s, d):
    """Fit, persist to the shared checkpoint folder, reload and score new rows (#4, #103)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    task = lineitem_task(s, d)
    train, test = M.stratified_split(task, "label", "row_key", 0.2, 42)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000)])
    model = pipe.fit(train)
    path = f"{checkpoint_dir(s).rstrip('/')}/models/{uuid.uuid4().hex}"
    M.save_model(model, path)
    loaded = M.load_pipeline(path)
    return M.predict(loaded, test).select("row_key", "label", "prediction", "score")


register(Query("predict_with_saved_model_lineitem", _predict_saved, None, operators=(4, 103)))


def _embeddings(s, d):
    e = table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"),
                                         F.col("label").cast("double").alias("label"))
    train, test = M.stratified_split(e, "label", "vec_id", 0.2, 42)
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000, family="multinomial").fit(train)
    scored = model.transform(test)
    return V.classification_metrics(scored).select(F.lit("embeddings_logistic").alias("model"), "*")


register(Query("embeddings_logistic_regression", _embeddings, None, operators=(88, 93)))


# ------------------------------------------------------------------ selection #74–#83
def _prepared(s, d):
    task = lineitem_task(s, d)
    cands = SEL.candidate_features(task, "label", exclude=["row_key"])
    return SEL.median_impute(task, cands), cands


register(Query("variance_threshold_lineitem",
               lambda s, d: SEL.variance_threshold(*_prepared(s, d)),
               union_all(f"SELECT 'variance' AS method, '{c}' AS feature, var_pop(CAST({c} AS DOUBLE)) AS score, "
                         f"coalesce(var_pop(CAST({c} AS DOUBLE)) > 0.01, false) AS selected FROM {TASK_SQL}" for c in FEATS),
               dbl=("score",), operators=(74, 75)))


def _fscore_sql() -> str:
    parts = []
    for c in FEATS:
        parts.append(f"""
SELECT '{c}' AS feature, (sum(n * power(m - grand, 2)) / (k - 1)) / (sum((n - 1) * coalesce(v, 0)) / (nn - k)) AS score
FROM (SELECT label, count(*) n, avg(CAST({c} AS DOUBLE)) m, var_samp(CAST({c} AS DOUBLE)) v FROM {TASK_SQL}
      WHERE label IS NOT NULL AND {c} IS NOT NULL GROUP BY label) g,
     (SELECT count(*) k, sum(n) nn, sum(n * m) / sum(n) grand FROM
        (SELECT count(*) n, avg(CAST({c} AS DOUBLE)) m FROM {TASK_SQL} WHERE label IS NOT NULL AND {c} IS NOT NULL
         GROUP BY label)) a
GROUP BY k, nn""")
    keep = max(min(10, len(FEATS)), int(len(FEATS) * 0.75))
    return f"""SELECT 'f_score' AS method, feature, score,
                      row_number() OVER (ORDER BY score DESC NULLS LAST, feature) <= {keep} AS selected
               FROM ({union_all(parts)})"""


register(Query("f_score_selection_lineitem",
               lambda s, d: SEL.f_score_selection(*_prepared(s, d), "label", k=10, percentile=75.0),
               _fscore_sql(), dbl=("score",), operators=(76,)))


def _filtered(s, d):
    """Prepared table, the variance frame, and the candidates that pass it: what every other selector sees."""
    df, cands = _prepared(s, d)
    var = SEL.variance_threshold(df, cands)
    return df, var, SEL.passing(var)


def _forest(extra):
    def run(s, d):
        df, _, cands = _filtered(s, d)
        frame = SEL.forest_importance(df, cands, "label", trees=100, extra=extra)
        return SEL.importance_lookup(frame, "extra_trees" if extra else "random_forest")
    return run


def _lasso(s, d):
    df, _, cands = _filtered(s, d)
    return SEL.lasso_selection(df, cands, "label")


def _rfe(s, d):
    df, _, cands = _filtered(s, d)
    return SEL.recursive_elimination(df, cands, "label", min_features=5, step=1, trees=50)


register(Query("random_forest_importance_selection_lineitem", _forest(False), None, dbl=("score",), operators=(77, 83)))
register(Query("extra_trees_importance_selection_lineitem", _forest(True), None, dbl=("score",), operators=(78, 83)))
register(Query("lasso_selection_lineitem", _lasso, None, dbl=("score",), operators=(79,)))
register(Query("recursive_elimination_lineitem", _rfe, None, dbl=("score",), operators=(80,)))


def _ballots(s, d):
    """All selectors' frames, one row a feature each, computed from the tables in every call and cut once: the vote and
    the report read them several times."""
    df, var, cands = _filtered(s, d)
    rows = SEL.binned(df, cands, "label")   # the three forest selectors read these
    frames = {"variance": var, "statistical": SEL.f_score_selection(df, cands, "label"),
              "random_forest": SEL.forest_importance(df, cands, "label", trees=100, rows=rows),
              "extra_trees": SEL.forest_importance(df, cands, "label", trees=100, extra=True, rows=rows),
              "lasso": SEL.lasso_selection(df, cands, "label"),
              "rfe": SEL.recursive_elimination(df, cands, "label", min_features=5, trees=50, rows=rows)}
    return {k: cut_lineage(v) for k, v in frames.items()}


def _elected(b):
    model_based = SEL.model_based_union(b["random_forest"], b["extra_trees"], b["lasso"])
    return SEL.vote(b["variance"], b["statistical"], model_based, b["rfe"], b["random_forest"])


def _vote(s, d):
    return _elected(_ballots(s, d))


register(Query("feature_vote_lineitem", _vote, None, dbl=("rf_importance",), operators=(81,)))


def _vote_fixed(s, d):
    """The vote on given ballots made from the table: a feature that fails the variance filter leads the forest's list."""
    df, cands = _prepared(s, d)
    var = SEL.variance_threshold(df, cands)
    row = lambda m, picks: s.createDataFrame([(m, f, float(len(cands) - i), f in picks) for i, f in enumerate(reversed(FEATS))],
                                             "method string, feature string, score double, selected boolean")
    return SEL.vote(var, row("statistical", FEATS[:3]), row("model", FEATS[1:4]), row("rfe", [FEATS[0], FEATS[6]]), row("random_forest", FEATS))


register(Query("feature_vote_given_ballots_lineitem", _vote_fixed,
               "WITH var AS (" + union_all(f"SELECT '{c}' AS feature, var_pop(CAST({c} AS DOUBLE)) > 0.01 AS ok FROM {TASK_SQL}" for c in FEATS)
               + "), given(feature, votes, rf_importance) AS (VALUES "
               + ", ".join(f"('{c}', {(i < 3) + (1 <= i < 4) + (i in (0, 6))}, {float(i + 1)})" for i, c in enumerate(FEATS))
               + ") SELECT g.feature, CAST(votes AS BIGINT) AS votes, CAST(rf_importance AS DOUBLE) AS rf_importance FROM given g JOIN var USING (feature) WHERE ok",
               dbl=("rf_importance",), ints=("votes",), operators=(81,)))


def _project(s, d):
    task = lineitem_task(s, d)
    sel = [r["feature"] for r in _vote(s, d).collect()]   # at most the cap (25) names
    return SEL.project_selected(task, sel, ["row_key", "label"])


register(Query("project_selected_lineitem", _project, None, operators=(82,)))


def _report(s, d):
    frames = _ballots(s, d)
    return SEL.selection_report(frames, _elected(frames), frames["random_forest"])


register(Query("selection_report_lineitem", _report, None, dbl=("value",), operators=(7,)))


def _stream_scoring(s, d):
    """Fit on the train split, land the test rows as files, drain them through a streaming scorer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from tabulon.streaming.scoring import drain
    task = lineitem_task(s, d)
    train, test = M.stratified_split(task, "label", "row_key", 0.2, 42)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"),
                             LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000)]).fit(train)
    base = f"{checkpoint_dir(s).rstrip('/')}/landing/{uuid.uuid4().hex}"
    test.write.parquet(f"{base}/in")
    return drain(s, model, f"{base}/in", test.schema, f"{base}/out", ["row_key", "label"])


register(Query("stream_scoring_lineitem", _stream_scoring, None, operators=(103,)))
