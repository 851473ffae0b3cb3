"""Boosting on weighted cells against Spark's boosting on the rows themselves."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import boosted as B
from tabulon.operators import forest as FO
from tabulon.operators import models as M


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (3000, 3)) * np.array([1.0, 0.5, 10.0])
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 30)).astype(float)
    y = np.where(rng.random(len(x)) < 0.2, 1 - y, y)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y, row_key=np.arange(len(x)))
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf)).select("row_key", "features", "label")


def scores(model, df):
    return {r["row_key"]: r["p"] for r in model.transform(df).select("row_key", vector_to_array("probability")[1].alias("p")).collect()}


def test_boosting_on_cells_is_that_on_rows(task, tmp_path):
    model = M.gradient_boosting(iters=4, depth=3).fit(task)
    stock = GBTClassifier(featuresCol="features", labelCol="label", maxIter=4, stepSize=0.1, maxDepth=3, seed=42).fit(task)
    mine, theirs = scores(model, task), scores(stock, task)
    assert all(mine[k] == pytest.approx(p, abs=1e-9) for k, p in theirs.items())
    model.write().save(str(tmp_path / "m"))
    assert scores(PipelineModel.load(str(tmp_path / "m")), task) == mine
    assert "_bins" not in model.transform(task).columns


def test_boosting_reads_a_row_for_each_cell(task, monkeypatch):
    seen = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: seen.append(df.agg(F.count("*"), F.sum("_rows")).first()) or fit(self, df, *a))
    M.gradient_boosting(iters=1, depth=2).fit(task)
    assert seen[0][0] <= 2 * 6**3 and seen[0][1] == 3000


def test_thresholds_of_few_and_many_values(spark):
    n = 2000
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(n) % 3 * 1.0, "b": np.arange(n) * 1.0, "c": np.where(np.arange(n) == 7, 5.0, 1.0), "d": [None] * n}).astype(float))
    a, b, c, d = B.thresholds(df, list("abcd"), 32)
    assert (a, c, d) == ([0.5, 1.5], [3.0], []) and len(b) == 31
    part = np.histogram(np.arange(n), [-1, *b, n])[0]
    assert part.min() > n / 32 * 0.8 and part.max() < n / 32 * 1.2


def test_trees_of_cells_are_trees_of_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (2000, 3)).astype(np.uint8)
    y, keys = (rng.random(2000) < 0.3 + 0.1 * x[:, 0]).astype(np.uint8), np.arange(2000)
    cells, cell = np.unique(x, axis=0, return_inverse=True)
    for spec in (FO.ForestSpec(without_fold=1), FO.ForestSpec(extra=True, bootstrap=False)):
        fold = keys % 3
        w, hit = FO._cell_sums(spec, 2, keys, fold, y, cell.ravel(), len(cells))
        rows = FO._weights(spec, 2, keys) * (fold != spec.without_fold)
        held = rows > 0
        whole = FO.grow_subtree(x[held], y[held], rows[held], np.uint64(9), 0, spec)
        small = FO.grow_cells(cells[w > 0], w[w > 0], hit[w > 0], np.uint64(9), 0, spec)
        assert all(np.array_equal(whole[k], small[k]) for k in ("feature", "cut", "child", "value")) and np.allclose(whole["gain"], small["gain"])


def test_random_forest_is_grown_on_cells_to_its_depth(task):
    model = M.random_forest(trees=3, depth=2).fit(task)
    assert isinstance(model, FO.ForestModel) and max(len(FO._decoded(t)[1]) for t in model.state.collect()) <= 7


def test_svm_fits_follow_one_another(task, monkeypatch):
    """Each fit holds its rows' mapped features in memory; no two do at a time."""
    from pyspark.ml.classification import LinearSVC
    from tabulon.operators import ensemble as EN
    running, most = [], []
    fit = LinearSVC.fit

    def one(self, df, *a):
        running.append(1)
        most.append(len(running))
        try:
            return fit(self, df, *a)
        finally:
            running.pop()

    monkeypatch.setattr(LinearSVC, "fit", one)
    EN.fit_rbf_svm(task, 3, components=8, max_iter=3, folds=2)
    assert most == [1, 1, 1]


def test_missing_labels_and_features_are_refused(task):
    broken = task.withColumn("label", F.when(F.col("row_key") > 5, F.col("label")))
    for estimator in (M.random_forest(trees=2, depth=2), M.gradient_boosting(iters=1, depth=2)):
        with pytest.raises(Exception, match="(?i)label"):
            estimator.fit(broken)
