"""Seven models trained, evaluated, compared, saved and asked by name."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import ensemble as EN
from tabulon.operators import forest as FO
from tabulon.operators import models as M

NAMES = ["random_forest", "gradient_boosting", "svm", "logistic_regression", "extra_trees", "voting_classifier", "stacking_classifier"]


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, 400)) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y, row_key=np.arange(400))
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf).repartition(3))
    return M.stratified_split(df.select("row_key", "features", "label"), "label", "row_key", 0.25)


@pytest.fixture(scope="module")
def models(task):
    patch = pytest.MonkeyPatch()
    forest, boost, extra = M.random_forest, M.gradient_boosting, M.extra_trees
    patch.setattr(M, "random_forest", lambda **k: forest(trees=4, depth=4))
    patch.setattr(M, "gradient_boosting", lambda **k: boost(iters=3, depth=2))
    patch.setattr(M, "extra_trees", lambda **k: extra(trees=4))
    patch.setattr(FO.ForestSpec.__init__, "__defaults__", (4, *FO.ForestSpec.__init__.__defaults__[1:]))
    out = M.train_models(task[0], "row_key", 3, folds=2, svm={"components": 20, "max_iter": 10, "folds": 2})
    patch.undo()
    return out


def rows(df):
    return {r["row_key"]: (r["prediction"], round(r["p"], 9)) for r in
            df.select("row_key", "prediction", vector_to_array("probability")[1].alias("p")).collect()}


def test_all_models_save_load_and_predict_by_name(spark, task, models, tmp_path):
    _, test = task
    assert list(models) == NAMES
    for name, model in models.items():
        EN.save_model(model, f"{tmp_path}/{name}")
        again = EN.predict_by_name(spark, str(tmp_path), name, test)
        assert rows(again) == rows(model.transform(test)), name
        assert all(0 <= r["score"] <= 1 for r in again.collect())


def test_vote_is_the_mean_and_the_stack_its_regression(task, models):
    _, test = task
    member = [rows(models[n].transform(test)) for n in ("random_forest", "gradient_boosting", "logistic_regression")]
    for k, (label, p) in rows(models["voting_classifier"].transform(test)).items():
        assert p == pytest.approx(np.mean([m[k][1] for m in member]), abs=1e-6) and label == float(p > 0.5)
    stack = models["stacking_classifier"].members
    assert list(stack) == ["rf", "gb", "et", "meta"]
    parts = [rows(stack[n].transform(test)) for n in ("rf", "gb", "et")]
    for k, (_, p) in rows(models["stacking_classifier"].transform(test)).items():
        z = stack["meta"].intercept + sum(w * m[k][1] for w, m in zip(stack["meta"].coefficients, parts))
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_evaluation_and_choice(task, models):
    _, test = task
    metrics = EN.evaluate_models(models, test)
    by_model = {r["model"]: r for r in metrics.collect()}
    assert list(sorted(by_model, key=lambda n: by_model[n]["model_order"])) == NAMES
    for name, model in models.items():
        scored = model.transform(test).select("label", "prediction").collect()
        assert by_model[name]["accuracy"] == pytest.approx(np.mean([r["label"] == r["prediction"] for r in scored]))
        assert by_model[name]["accuracy"] > 0.7 and by_model[name]["roc_auc"] > 0.8
    got = {(r["section"], r["name"]): r for r in EN.choose(metrics).where("section <> 'metric'").collect()}
    accuracy = [by_model[n]["accuracy"] for n in NAMES]
    best = NAMES[int(np.argmax(accuracy))]
    assert (got["best", "accuracy"]["model"], got["recommendation", "best_accuracy"]["model"], got["comparison_best", "accuracy"]["model"]) == (best,) * 3
    assert got["comparison_mean", "accuracy"]["value"] == pytest.approx(np.mean(accuracy))
    assert got["comparison_std", "accuracy"]["value"] == pytest.approx(np.std(accuracy))


def test_svm_sigmoid_follows_out_of_fold_margins(task, models):
    train, _ = task
    svm = models["svm"]
    out = svm.transform(train).select("label", "prediction", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m"))
    sig = svm.stages[-1]
    for r in out.collect():
        z = sig.getOrDefault("slope") * r["m"] + sig.getOrDefault("intercept")
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert sig.getOrDefault("slope") > 0
    assert abs(out.agg(F.avg("p") - F.avg("label")).first()[0]) < 0.1
