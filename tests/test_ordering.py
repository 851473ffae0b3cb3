"""The two-level global order primitives against pandas/numpy on small fixtures."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.plans.ordering import average_ranks, exact_quantiles, running_totals


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.integers(0, 40, 300), np.full(200, 17)])   # a hot value holding 40 % of rows
    g = rng.choice(["a", "b", "c"], size=len(v), p=[0.6, 0.3, 0.1])
    pdf = pd.DataFrame({"g": g, "v": v.astype(float)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_running_totals_match_cumsum(values, buckets):
    pdf, df = values
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    got = running_totals(counts, "v", ["w"], n_buckets=buckets).toPandas().sort_values("v")
    exp = pdf.groupby("v").size().sort_index().cumsum()
    assert got["w_cum"].tolist() == exp.tolist()
    assert (got["w_total"] == len(pdf)).all()


def test_running_totals_descending_grouped(values):
    pdf, df = values
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    got = running_totals(counts, "v", ["w"], by=["g"], descending=True, n_buckets=4).toPandas()
    for g, sub in pdf.groupby("g"):
        exp = sub.groupby("v").size().sort_index(ascending=False).cumsum()
        mine = got[got.g == g].set_index("v")["w_cum"].sort_index(ascending=False)
        assert mine.tolist() == exp.tolist()


def test_average_ranks_match_pandas(values):
    pdf, df = values
    got = average_ranks(df, "v").toPandas().set_index("v")["rank"]
    exp = pdf.assign(r=pdf.v.rank(method="average")).groupby("v")["r"].first()
    assert np.allclose(got.sort_index().values, exp.sort_index().values)


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 0.1, 0.95, 1.0]])
def test_exact_quantiles_match_numpy(values, probs):
    pdf, df = values
    row = exact_quantiles(df, "v", probs).first()
    exp = np.percentile(pdf.v, [p * 100 for p in probs])
    assert np.allclose(list(row), exp)


def test_grouped_quantiles(values):
    pdf, df = values
    got = exact_quantiles(df, "v", [0.5], by=["g"], names=["med"]).toPandas().set_index("g")["med"]
    exp = pdf.groupby("g")["v"].median()
    assert np.allclose(got.sort_index().values, exp.sort_index().values)


def test_quantiles_with_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (None,), (float("nan"),)], "v double")
    assert list(exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first()) == [1.0, 2.0, float("inf")]
    assert list(exact_quantiles(df.limit(0), "v", [0.5]).first()) == [None]


def test_quantiles_of_many_rows_need_few_values(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=60_000), np.full(40_000, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(5)
    got = list(exact_quantiles(df, "v", [0.001, 0.25, 0.5, 0.9, 0.9999]).first())
    assert np.allclose(got, np.quantile(x, [0.001, 0.25, 0.5, 0.9, 0.9999]), atol=0, rtol=1e-12)


def test_quantiles_of_small_groups(spark):
    rows = [(n, float(i * i % 17)) for n in range(1, 40) for i in range(n)]
    got = exact_quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0.25, 0.5, 0.9], by=["g"]).collect()
    for r in got:
        assert np.allclose(list(r)[1:], np.quantile([v for g, v in rows if g == r["g"]], [0.25, 0.5, 0.9]))
    assert len(got) == 39


def test_quantiles_of_several_columns_and_groups(spark, monkeypatch):
    """Brackets that hold more rows than allowed are narrowed, brackets that miss their rank are widened."""
    from tabulon.plans import ordering as O
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25)])
    g = rng.integers(0, 2, len(x))
    df = spark.createDataFrame(pd.DataFrame({"v": x, "u": np.round(x * 3), "g": g})).repartition(4)
    probs, real = [0.0, 0.003, 0.25, 0.5, 0.97, 1.0], F.expr
    names = [f"p{i}" for i in range(len(probs))]
    for few, sketch in ((200_000, "20000"), (40, "20000"), (200_000, "30")):
        monkeypatch.setattr(O, "_FEW", few)
        monkeypatch.setattr(O.F, "expr", lambda s, k=sketch: real(s.replace(", 20000)", f", {k})")))
        for r in O.quantiles_of(df, ["v", "u"], probs, names=names).collect():
            assert np.allclose(list(r)[1:], np.quantile(x if r["variable"] == "v" else np.round(x * 3), probs), rtol=1e-12, atol=0)
    for r in O.quantiles_of(df, ["v", "u"], probs, by=["g"], names=names).collect():
        mine = x[g == r["g"]]
        assert np.allclose(list(r)[2:], np.quantile(mine if r["variable"] == "v" else np.round(mine * 3), probs), rtol=1e-12, atol=0)
    empty = O.quantiles_of(df.where("v > 99"), ["v"], [0.5], names=["m"]).collect()
    assert [(r["variable"], r["m"]) for r in empty] == [("v", None)]


def test_quantiles_between_frequent_values_need_no_more_passes(spark, monkeypatch):
    """A rank between two values of many rows has a bracket that can't be narrowed; it is ranked as it is, not tried again."""
    from tabulon.plans import ordering as O
    steps, real = [], O._Brackets.step
    monkeypatch.setattr(O, "_FEW", 1_000)
    monkeypatch.setattr(O._Brackets, "step", lambda self, *a: (steps.append(1), real(self, *a))[1])
    df = spark.range(60_000).selectExpr("id % 3 AS g", "CAST(id % 2 AS DOUBLE) + 1 AS v")
    assert list(exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first()) == [1.0, 1.5, 2.0]
    assert len(steps) == 2
    steps.clear()
    monkeypatch.setattr(O, "_ACCURACY", 10_000)
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=["g"]).orderBy("g").collect()
    assert [list(r) for r in got] == [[g, 1.0, 1.5, 2.0] for g in range(3)]
    assert len(steps) == 2
