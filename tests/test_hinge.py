"""Linear SVMs in shared passes against Spark's own on the mapped rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.operators import ensemble as EN
from tabulon.operators import hinge as H


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] * x[:, 1] + rng.normal(0, 0.4, 900)) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y, fold=np.arange(900) % 3)
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf).repartition(3))


def test_same_models_as_on_kept_rows_in_fewer_passes(df, monkeypatch):
    """no row's mapped numbers are kept, and the fits share their passes."""
    rff = EN.RandomFourier.of(inputCol="features", outputCol="z", width=3, components=30, gamma=0.5, seed=1)
    z, rows = rff.transform(df).select("z", "label", "fold").cache(), H.packed(df, "features", F.col("fold"))
    passes, plain = [], H._losses
    monkeypatch.setattr(H, "_losses", lambda *a: passes.append(a[3].shape[1]) or plain(*a))
    got = H.fit_folds(rows, *rff.matrices(), [0, 1, 2, -1], 0.001, 15)
    for k, (coef, intercept) in zip((0, 1, 2, -1), got, strict=True):
        want = LinearSVC(featuresCol="z", labelCol="label", regParam=0.001, maxIter=15).fit(z.where(F.col("fold") != k))
        np.testing.assert_allclose(coef, want.coefficients.toArray(), rtol=1e-6, atol=1e-6)
        assert intercept == pytest.approx(want.intercept, abs=1e-6)
    assert len(passes) < 40 and max(passes) == 12
    margin = {round(r["margin"], 6) for r in H.margins(rows, *rff.matrices(), dict(enumerate(got[:3]))).collect()}
    assert len(margin) > 890


def test_rows_that_no_svm_can_learn_from_are_an_error(spark, df):
    for bad in (df.withColumn("label", F.lit(2.0)), df.withColumn("label", F.when(F.col("fold") > 0, 1.0))):
        with pytest.raises(Exception, match="labels must be 0 or 1"):
            H.packed(bad, "features", F.col("fold"))


def test_cosine():
    x = np.random.default_rng(1).normal(size=(50, 20)) * 30
    np.testing.assert_allclose(H.cosine(x.copy()), np.cos(x), atol=2e-14)
