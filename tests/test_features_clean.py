"""Feature creation and cleaning on the FIXTURES frames (F2, F3, F6) and the survey goldens."""
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import features as X
from tabulon.operators import quality as Q


def test_f3_derived_features(spark):
    rows = [(25, 5, 1, 1, "Assam", 0, 1), (35, 15, 0, 0, "Manipur", 1, 0), (45, 25, 1, 1, "Sikkim", 0, 0),
            (55, 35, 0, 0, "Nagaland", 1, 1)]
    df = spark.createDataFrame(rows, "Age long, Years_of_Experience long, GI_Aware_Binary int, Gender_Binary int, "
                                     "State string, Received_Subsidy_Binary int, Uses_Ecommerce_Binary int")
    out = df.withColumns({"Career_Start_Age": F.col("Age") - F.col("Years_of_Experience"),
                          "Age_Experience_Ratio": F.try_divide(F.col("Age").cast("double"),
                                                               (F.col("Years_of_Experience") + 1).cast("double"))})
    assert {r[0] for r in out.select("Career_Start_Age").collect()} == {20}
    binned = X.labelled_bins(df, "Age", [0, 25, 35, 45, 55, 100], ["Young", "Adult", "Middle_Age", "Senior", "Elder"], "g")
    # right-closed edges: 25 → Young, 35 → Adult, 45 → Middle_Age, 55 → Senior
    assert [r[0] for r in binned.orderBy("Age").select("g").collect()] == ["Young", "Adult", "Middle_Age", "Senior"]


def test_bin_edges_and_codes(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [0, 25, 35, 100, None]], "x double")
    lab = X.labelled_bins(df, "x", [0, 25, 35, 100], ["a", "b", "c"], "lab").orderBy(F.col("x").asc_nulls_last())
    assert [r["lab"] for r in lab.collect()] == [None, "a", "b", "c", None]   # 0 is outside (0, 25]
    ew = X.equal_width_bins(df, "x", 4, "code").orderBy(F.col("x").asc_nulls_last())
    assert [r["code"] for r in ew.collect()] == [0, 0, 1, 3, None]            # minimum lands in bin 0
    qb = X.quantile_bins(spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double"), "x", 4, "q")
    assert [r["q"] for r in qb.orderBy("x").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_polynomial_names(spark):
    names = [n for n, _ in X.polynomial_terms(["a", "b", "c"], 2)]
    assert names == ["a^2", "a b", "a c", "b^2", "b c", "c^2"]
    df = X.polynomial_features(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), ["a", "b"], 2)
    r = df.first()
    assert (r["a^2"], r["a b"], r["b^2"]) == (4.0, 6.0, 9.0)


def test_encodings(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("b", 0), (None, 1)], "s string, y int")
    oh = X.one_hot(df, "s", "S").collect()
    assert all(not (r["S_a"] or r["S_b"]) for r in oh if r["s"] is None)
    le = {r["s"]: r["code"] for r in X.label_encode(df.where("s is not null"), "s", "code").collect()}
    assert le == {"a": 0, "b": 1}
    te = {r["s"]: r["t"] for r in X.target_encode(df, "s", "y", "t").collect() if r["s"]}
    assert te == {"a": 0.0, "b": 0.5}
    fe = {r["s"]: r["f"] for r in X.frequency_encode(df, "s", "f").collect() if r["s"]}
    assert fe == {"a": 1, "b": 2}


def test_standard_scaler_population_sd_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    out, params = X.standard_scale(df, ["x", "c"])
    xs = sorted(r["x_scaled"] for r in out.collect())
    # median fill (2.0) then population sd of [1, 2, 3, 2]
    import numpy as np
    v = np.array([1, 2, 3, 2.0])
    assert xs == pytest.approx(sorted((v - v.mean()) / v.std()))
    assert {r["c_scaled"] for r in out.collect()} == {0.0}


def _f2_frame(spark):
    states = ["Assam", "Manipur", "Sikkim"]
    ages = [18, 64, 33, 47, 25, 52, 39, 61, 29, 44, 35, 58, 22, 50, 41, 27, 63, 31, 55, 38, 46, 20, 60, 36, 53, 24, 49, 42,
            57, 30]
    exps = [1, 39, 12, 25, 4, 30, 18, 35, 8, 22, 15, 33, 2, 28, 20, 6, 38, 10, 31, 16, 24, 3, 36, 14, 29, 5, 26, 21,
            34, 9]
    rows = []
    for i in range(30):
        rows.append((states[i % 3], 1001 + i, "Male" if i % 2 == 0 else "Female", "Yes" if i % 2 == 0 else "No",
                     "No" if i % 2 == 0 else "Yes", ["No", "No", "Yes"][i % 3], ages[i], exps[i], i))
    return spark.createDataFrame(rows, "State string, Artisan_ID long, Gender string, GI_Aware string, "
                                       "Received_Subsidy string, Uses_Ecommerce string, Age long, "
                                       "Years_of_Experience long, _row_order long")


def test_f2_cleaning_pipeline(spark):
    df = _f2_frame(spark)
    out = C.clean_data(df, id_col="Artisan_ID", order=["_row_order"],
                       categories=["State", "Gender", "GI_Aware", "Received_Subsidy", "Uses_Ecommerce"],
                       binary={"GI_Aware": "Yes", "Received_Subsidy": "Yes", "Uses_Ecommerce": "Yes", "Gender": "Male"},
                       numeric=("Age", "Years_of_Experience"), outlier_kwargs={"key": "Artisan_ID", "trees": 20})
    cols = set(out.columns)
    assert {"GI_Aware_Binary", "Received_Subsidy_Binary", "Uses_Ecommerce_Binary", "Gender_Binary", "is_outlier"} <= cols
    assert "_row_order" not in cols
    viol = Q.post_clean_violations(out, ["Age", "Years_of_Experience"]).first()
    assert viol["rows"] == 30 and viol["null_cells"] == 0
    assert viol["negative_Age"] == 0


def test_dedupe_keeps_first_in_order(spark):
    df = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (2, "x", 5), (None, "n1", 3), (None, "n2", 4)],
                               "id int, v string, o int")
    got = {(r["id"], r["v"]) for r in C.dedupe_first(df, "id", ["o"]).collect()}
    assert got == {(1, "early"), (2, "x"), (None, "n1")}
    assert Q.duplicate_key_count(df, "id").first()[0] == 2


def test_standardize_and_binary(spark):
    df = spark.createDataFrame([(" yes ",), ("YES",), (None,), ("no",)], "a string")
    out = C.binary_encode(C.standardize_categories(df, ["a"]), {"a": "Yes"}).collect()
    assert [(r["a"], r["a_Binary"]) for r in out] == [("Yes", 1), ("Yes", 1), (None, 0), ("No", 0)]


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert C.column_modes(df, ["s"]).first()["mode"] == "a"
    assert C.mode_impute(df, ["s"]).where("s is null").count() == 0


def test_knn_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    n = 60
    a = rng.integers(18, 65, n).astype(float)
    b = rng.integers(1, 40, n).astype(float)
    a_m, b_m = a.copy(), b.copy()
    a_m[[3, 7, 20]] = np.nan
    b_m[[5, 9]] = np.nan
    a_m[30] = np.nan
    b_m[30] = np.nan
    rows = [(i, None if np.isnan(x) else float(x), None if np.isnan(y) else float(y)) for i, (x, y) in enumerate(zip(a_m, b_m))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in C.knn_impute(df, ("a", "b"), "id", k=5).collect()}
    donors = [i for i in range(n) if not np.isnan(a_m[i]) and not np.isnan(b_m[i])]

    def brute(target, feature, i):
        cand = sorted(donors, key=lambda j: (abs(feature[j] - feature[i]), j))[:5]
        return float(np.mean([target[j] for j in cand]))

    for i in (3, 7, 20):
        assert got[i][0] == pytest.approx(brute(a_m, b_m, i))
    for i in (5, 9):
        assert got[i][1] == pytest.approx(brute(b_m, a_m, i))
    assert got[30][0] == pytest.approx(np.nanmean(a_m))


def test_knn_with_a_hot_donor_value_and_rows_missing_both(spark):
    """Against brute force: 40 % of the donors share one value, many rows ask for the same value, ties go to smaller ids."""
    import numpy as np
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        x = 7.0 if rng.random() < 0.4 else float(rng.integers(0, 30))
        y = float(rng.integers(0, 100))
        gone = rng.random()
        rows.append((int(i * 7 % 601), None if gone < 0.1 or 0.2 <= gone < 0.23 else x, None if 0.1 <= gone < 0.23 else y))
    both = [r for r in rows if r[1] is not None and r[2] is not None]
    mean = [np.mean([r[c] for r in rows if r[c] is not None]) for c in (1, 2)]

    def near(value, at, of, k=5):
        return np.mean([r[of] for r in sorted(both, key=lambda r: (abs(r[at] - value), r[0]))[:k]])

    got = {r["id"]: r for r in C.knn_impute(spark.createDataFrame(rows, "id long, x double, y double").repartition(4), ("x", "y"), "id").collect()}
    assert len(got) == len(rows)
    for i, x, y in rows:
        want_x = x if x is not None else (near(y, 2, 1) if y is not None else mean[0])
        want_y = y if y is not None else (near(x, 1, 2) if x is not None else mean[1])
        assert got[i]["x"] == pytest.approx(want_x) and got[i]["y"] == pytest.approx(want_y)


def test_dominance_against_all_pairs():
    import numpy as np
    from tabulon.operators.dependence import dominance
    rng = np.random.default_rng(12)
    for n, k in ((2, 2), (50, 4), (200, 30), (200, 1000), (1, 1)):
        o, r, w = rng.integers(0, k, n).astype(float), rng.normal(size=n).round(1), rng.integers(1, 5, n).astype(float)
        want = sum(w[j] * w[(o < o[j]) & (r < r[j])].sum() for j in range(n))
        assert dominance(o, r, w) == pytest.approx(want)
