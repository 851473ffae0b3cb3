"""Models (F4 invariants), quality profiles and report tables."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import models as M
from tabulon.operators import quality as Q
from tabulon.operators import report as R


@pytest.fixture(scope="module")
def f4(spark):
    rng = np.random.default_rng(42)
    n = 100
    rows = [(int(rng.integers(18, 65)), int(rng.integers(1, 40)), int(rng.integers(0, 2)), int(rng.integers(0, 8)),
             int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 2)), 1001 + i) for i in range(n)]
    return spark.createDataFrame(rows, "Age long, Years_of_Experience long, Gender_Binary long, State_Encoded long, "
                                       "GI_Aware_Binary long, Received_Subsidy_Binary long, Uses_Ecommerce_Binary long, "
                                       "Artisan_ID long")


FEATS = ["Age", "Years_of_Experience", "Gender_Binary", "State_Encoded", "Received_Subsidy_Binary",
         "Uses_Ecommerce_Binary"]


def test_split_sizes_add_up(f4):
    train, test = M.stratified_split(f4, "GI_Aware_Binary", "Artisan_ID", 0.2, 42)
    assert train.count() + test.count() == 100
    per = {r[0]: r[1] for r in f4.groupBy("GI_Aware_Binary").count().collect()}
    tper = {r[0]: r[1] for r in test.groupBy("GI_Aware_Binary").count().collect()}
    assert tper == M.test_sizes(per, 0.2) and sum(tper.values()) == 20


def test_split_takes_largest_remainders(spark):
    assert M.test_sizes({0: 103, 1: 217}, 0.2) == {0: 21, 1: 43}
    df = spark.createDataFrame([(i, int(i < 217)) for i in range(320)], "k long, y int")
    for parts in (1, 7):
        train, test = M.stratified_split(df.repartition(parts), "y", "k", 0.2, 42)
        ids = sorted(r["k"] for r in test.collect())
        assert sorted(r["count"] for r in test.groupBy("y").count().collect()) == [21, 43] and train.count() == 256
        assert parts == 1 or ids == first
        first = ids


def test_isolation_flags_do_not_depend_on_partitions(spark):
    from tabulon.operators.outliers import isolation_forest_flag
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (3000, 2)))], "k long, a double, b double")
    flagged = [{r["k"] for r in isolation_forest_flag(df.repartition(n), ["a", "b"], trees=20, key="k").where("is_outlier").collect()}
               for n in (2, 16)]
    assert flagged[0] == flagged[1] and len(flagged[0]) == 150


def test_vote_never_takes_back_what_the_variance_filter_rejects(spark):
    from tabulon.operators import select as SEL
    names = [f"f{i}" for i in range(12)]
    row = lambda m, picks: spark.createDataFrame([(m, f, float(12 - i), f in picks) for i, f in enumerate(names)],
                                                 "method string, feature string, score double, selected boolean")
    got = SEL.vote(row("variance", names[2:8]), row("statistical", names[:4]), row("model", names[:4]), row("rfe", []), row("rf", []))
    assert [r["feature"] for r in got.collect()] == ["f2", "f3", "f4", "f5", "f6", "f7"]


def test_models_metrics_in_unit_interval(spark, f4, tmp_path):
    from tabulon.operators import evaluate as V
    train, test = M.stratified_split(f4, "GI_Aware_Binary", "Artisan_ID", 0.2, 42)
    tr = M.feature_frame(train, FEATS, "GI_Aware_Binary", keep=["Artisan_ID"])
    te = M.feature_frame(test, FEATS, "GI_Aware_Binary", keep=["Artisan_ID"])
    models = {"rf": M.random_forest(trees=20).fit(tr), "lr": M.logistic_regression(80).fit(tr)}
    for m in models.values():
        met = V.classification_metrics(M.predict(m, te), score="score").first()
        assert all(0.0 <= met[k] <= 1.0 for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc"))
    voted = M.soft_vote(models, te, "Artisan_ID")
    assert voted.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    path = str(tmp_path / "lr")
    M.save_model(models["lr"], path)
    from pyspark.ml.classification import LogisticRegressionModel
    again = LogisticRegressionModel.load(path)
    a = [r["prediction"] for r in models["lr"].transform(te).orderBy("Artisan_ID").collect()]
    b = [r["prediction"] for r in again.transform(te).orderBy("Artisan_ID").collect()]
    assert a == b
    svm = M.fit_rbf_svm(tr, len(FEATS), components=50)
    probs = svm.transform(te).select(M.vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1.0) < 1e-9 for r in probs)


def test_quality_profiles(spark):
    df = spark.createDataFrame([(1, "Yes", 30), (2, "No", -1), (2, "maybe", 200), (None, None, 40)],
                               "id int, flag string, age int")
    assert Q.duplicate_key_count(df, "id").first()[0] == 1
    rv = {r["variable"]: r["violations"] for r in Q.range_violations(df, {"age": (0, 120)}).collect()}
    assert rv == {"age": 2}
    dv = {(r["value"], r["count"]) for r in Q.domain_violations(df, {"flag": ["Yes", "No"]}).collect()}
    assert dv == {("maybe", 1), (None, 1)}
    nulls = {r["variable"]: r["nulls"] for r in Q.null_counts(df).collect()}
    assert nulls == {"id": 1, "flag": 1, "age": 0}
    with pytest.raises(ValueError):
        Q.require_columns(df, ["id", "missing"])
    mixed = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",)], "v string")
    assert dict(Q.fix_mixed_types(mixed).dtypes)["v"] == "string"          # 80 % is not above the threshold
    mixed2 = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",), ("x",)], "v string")
    assert dict(Q.fix_mixed_types(mixed2).dtypes)["v"] == "double"


def test_report_tables(survey):
    from tabulon.plans import survey as SV
    imp = SV.impact(survey).first()
    assert imp["gi_awareness_rate"] == pytest.approx(67.8125)
    assert imp["ecommerce_adoption_rate"] == pytest.approx(26.5625)
    assert imp["subsidy_coverage"] == pytest.approx(34.375)
    assert round(imp["gender_gap"], 1) == 6.8
    pri = {r["metric"] for r in SV.priorities(survey).collect()}
    assert pri == {"gi_awareness_rate", "ecommerce_adoption_rate"}
    prof = {r["State"]: r["GI_Aware"] for r in R.group_profile(survey, "State", yes_cols=["GI_Aware"]).collect()}
    assert prof["Assam"] == pytest.approx(round(23 / 35 * 100, 2))
    assert prof["Mizoram"] == pytest.approx(round(26 / 35 * 100, 2))
    box = {r["variable"]: r for r in R.box_stats(survey, ["Age"]).collect()}
    assert (box["Age"]["q1"], box["Age"]["q3"], box["Age"]["fliers"]) == (28.0, 52.25, 0)
    hist = R.histogram(survey, "Age").collect()
    assert sum(r["count"] for r in hist) == 320
    counts, _ = np.histogram(np.array([r["Age"] for r in survey.select("Age").collect()], dtype=float), bins="auto")
    assert [r["count"] for r in hist] == counts.tolist()


def test_tuning_searches_and_scores_all_training_rows(spark, monkeypatch):
    from tabulon.operators import forest as FO
    from tabulon.operators import search as SR
    from tabulon.plans import bind_models as B
    from tests.conftest import SF001
    monkeypatch.setattr(SR, "RANGES", {"trees": (2, 4), "depth": (2, 5), "min_split": (2, 9), "min_leaf": (1, 5)})
    train, _ = B.split_frames(spark, SF001)
    seen = {}
    real = M.search_forest
    monkeypatch.setattr(M, "search_forest", lambda rows, *a, **k: seen.setdefault("out", (rows, real(rows, *a, **k)))[1])
    tried, model = M.tune_random_forest(train, fits=5, first=3)
    rows, (points, best) = seen["out"]
    data = rows.collect()
    assert train.count() == len(data) > 4000
    sizes = sorted(r["count"] for r in rows.groupBy("y", "fold").count().where("y = 1").collect())
    assert len(sizes) == 3 and sizes[-1] - sizes[0] <= 1   # folds are stratified
    got = sorted(tried.collect(), key=lambda r: r["point"])
    assert [r["model_based"] for r in got] == [False] * 3 + [True] * 2
    x = np.stack([np.frombuffer(bytes(r["x"]), np.uint8) for r in data])
    key, y, fold = (np.array([r[c] for r in data]) for c in ("key", "y", "fold"))
    top = max(got, key=lambda r: (r["cv_accuracy"], -r["point"]))
    hits = []
    for k in range(3):   # by hand: every tree from all rows outside the fold, scored on all rows inside it
        p, fit = np.zeros((fold == k).sum()), fold != k
        for t in range(best.trees):
            w = FO._weights(best, t, key)
            on = fit & (w > 0)
            tree = FO.grow_subtree(x[on], y[on], w[on], FO._root(best, t), 0, best)
            p += tree["value"][FO._walk((tree["feature"], tree["cut"], tree["child"]), x[fold == k])]
        hits.append(np.mean((p / best.trees > 0.5) == (y[fold == k] == 1)))
    assert (top["trees"], top["depth"]) == (best.trees, best.depth) and top["cv_accuracy"] == pytest.approx(np.mean(hits))
    assert model.state.count() == best.trees


def test_search_goes_where_the_surrogate_expects_most():
    from tabulon.operators import search as SR
    rng = np.random.default_rng(3)
    truth = lambda p: -((p[1] - 14) / 17) ** 2 - 0.1 * (p[4] is None)
    tried = list(dict.fromkeys(SR.draw(rng, 10)))
    scores = [truth(p) for p in tried]
    for _ in range(4):
        new = SR.propose(tried, scores, 5, rng)
        assert len(set(new)) == 5 and not set(new) & set(tried)
        tried, scores = tried + new, scores + [truth(p) for p in new]
    assert max(scores) > -0.01 and max(scores) >= max(scores[:10])
    x, y = SR.encode(tried[:12]), np.array(scores[:12])
    mean, dev = SR.surrogate(x, y, x)
    assert np.abs(mean - y).max() < 0.2 and (dev > 0).all()
    assert SR.improvement(np.array([0.0, 1.0]), np.array([1e-6, 1e-6]), 0.5) == pytest.approx([0.0, 0.5])


def test_ballots_follow_rewritten_tables(spark, tmp_path, monkeypatch):
    from tabulon.operators import select as SEL
    from tabulon.plans import bind_models as B
    small, fits = lambda f, **fixed: lambda *a, **k: f(*a, **k | fixed), []
    monkeypatch.setattr(SEL, "forest_importance", small(SEL.forest_importance, trees=2, depth=2))
    monkeypatch.setattr(SEL, "lasso_selection", small(SEL.lasso_selection, folds=2))
    fixed = lambda df, cols, *a, **k: (fits.append(1), spark.createDataFrame(
        [("rfe", c, 1.0, True) for c in cols], "method string, feature string, score double, selected boolean"))[1]
    monkeypatch.setattr(SEL, "recursive_elimination", fixed)
    rng, at = np.random.default_rng(1), str(tmp_path)

    def land(scale):
        rows = [(i, 1, float(q), float(q * 10), float(x), 0.1, "R" if q > 25 else "N")
                for i, (q, x) in enumerate(zip(rng.integers(1, 50, 300), rng.normal(0, scale, 300)))]
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                    "l_discount double, l_tax double, l_returnflag string") \
            .write.mode("overwrite").parquet(f"{at}/lineitem.parquet")

    passing = lambda: {r["feature"] for r in B._ballots(spark, at)["variance"].where("selected").collect()}
    land(0.001)
    first = passing()
    land(1.0)
    assert "l_discount" in passing() - first and len(fits) == 2


def test_forests_grow_past_the_library_depth(spark):
    from tabulon.operators import forest as FO

    def depths(trees):
        out = []
        for t in trees.collect():
            _, feature, _, child, _ = FO._decoded(t)
            depth = np.zeros(len(feature), int)
            for i in np.flatnonzero(feature >= 0):   # children follow their parents
                depth[child[i]] = depth[child[i] + 1] = depth[i] + 1
            out.append(depth.max())
        return out

    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(rng.random() < 0.5)) for i, (a, b) in enumerate(rng.normal(0, 1, (1000, 2)))]   # noise
    df = spark.createDataFrame(rows, "row_key long, x0 double, x1 double, y double")
    data = M.feature_frame(df, ["x0", "x1"], "y", keep=["row_key"])
    free, held = (depths(M.extra_trees(trees=2, **how).fit(data).state) for how in ({}, {"depth": 7}))
    assert min(free) > 10 and held == [7, 7]


def test_lasso_path_against_closed_cases(spark):
    from tabulon.operators import lasso as L
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(400, 4)) - 0.0)
    q = q - q.mean(axis=0)
    x = np.column_stack([q[:, 0] * 30, q[:, 1] * 20, q[:, 2] * 10, rng.normal(size=400)])
    y = 0.8 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.05, 400) + 100
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, fold=np.arange(400) % 5)
    parts, means = L.products_by_fold(spark.createDataFrame(pdf).repartition(3), list("abcd"), "y", F.col("fold"))
    assert sorted(parts) == [0, 1, 2, 3, 4] and np.allclose(means, [*x.mean(axis=0), y.mean()])
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    c = np.cov(np.column_stack([x, y]).T, bias=True) * 400
    assert np.allclose(whole.centred(), c)
    # no penalty: least squares; one feature: soft threshold
    free = L.descend(whole, np.array([0.0]), tol=1e-12)[0]
    assert np.allclose(free, np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0], atol=1e-6)
    one = L.Products(whole.n, whole.s[[0, 4]], whole.g[np.ix_([0, 4], [0, 4])])
    rho, xx = c[0, 4], c[0, 0]
    for penalty in (0.1, 0.01):
        assert L.descend(one, np.array([penalty]))[0, 0] == pytest.approx(np.sign(rho) * max(abs(rho) - 400 * penalty, 0) / xx)
    # error by products against rows
    rest, held = sum([parts[f] for f in (2, 3, 4)], parts[1]), parts[0]
    w = L.descend(rest, np.array([0.02]))[0]
    fit, out = pdf["fold"] != 0, pdf["fold"] == 0
    b = y[fit].mean() - x[fit].mean(axis=0) @ w
    assert L.error(rest, held, w) == pytest.approx(np.mean((y[out] - b - x[out] @ w) ** 2))
    path = L.lasso_path(spark.createDataFrame(pdf), list("abcd"), "y", F.col("fold"))
    assert len(path["penalties"]) == 100 and path["best"] == path["penalties"][np.argmin(path["errors"])]
    assert abs(path["coefficients"][0] - 0.8) < 0.05 and abs(path["coefficients"][1] + 0.5) < 0.05
    constant = L.lasso_path(spark.createDataFrame(pdf.assign(y=1.0)), list("abcd"), "y", F.col("fold"))
    assert not constant["coefficients"].any()
