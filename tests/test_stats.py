"""Statistical operators against the FIXTURES goldens on the 320-row survey table."""
import pytest

from tabulon.operators import dependence as D
from tabulon.operators import stats as S

CHI2 = {("Gender", "GI_Aware"): (1.317764, 1, 0.064172), ("State", "GI_Aware"): (3.321527, 7, 0.101881),
        ("Gender", "Uses_Ecommerce"): (6.024197, 1, 0.137206), ("State", "Uses_Ecommerce"): (3.488987, 7, 0.104418),
        ("GI_Aware", "Received_Subsidy"): (4.157580, 1, 0.113984),
        ("Uses_Ecommerce", "Received_Subsidy"): (0.369570, 1, 0.033984)}


def test_describe_numeric(survey):
    rows = {r["variable"]: r for r in S.describe_numeric(survey, ["Age", "Years_of_Experience"]).collect()}
    a = rows["Age"]
    assert (a["mean"], a["median"], a["q25"], a["q75"], a["min"], a["max"]) == (40.43125, 40.0, 28.0, 52.25, 18.0, 64.0)
    assert a["std"] == pytest.approx(13.884260, abs=1e-6)
    assert a["skewness"] == pytest.approx(0.074739, abs=1e-6)
    assert a["kurtosis"] == pytest.approx(-1.234689, abs=1e-6)
    e = rows["Years_of_Experience"]
    assert (e["mean"], e["median"], e["q25"], e["q75"]) == (20.075, 21.0, 11.0, 30.0)
    assert e["skewness"] == pytest.approx(-0.039478, abs=1e-6)


def test_categorical_counts(survey):
    rows = S.describe_categorical(survey, ["State", "Gender"]).collect()
    counts = {(r["variable"], r["level"]): r["count"] for r in rows}
    assert counts[("State", "Meghalaya")] == 48 and counts[("State", "Assam")] == 35
    assert counts[("Gender", "Female")] == 192
    modes = {r["variable"]: r["level"] for r in rows if r["is_mode"]}
    assert modes == {"State": "Meghalaya", "Gender": "Female"}


def test_chi_square_yates_and_cramers_v(survey):
    res = S.with_chi2_pvalues(S.chi_square_tests(survey, list(CHI2))).collect()
    for r in res:
        chi2, dof, v = CHI2[(r["var1"], r["var2"])]
        assert r["chi2"] == pytest.approx(chi2, abs=1e-6)
        assert r["dof"] == dof
        assert r["cramers_v"] == pytest.approx(v, abs=1e-6)
    gg = [r for r in res if (r["var1"], r["var2"]) == ("Gender", "GI_Aware")][0]
    assert gg["p_value"] == pytest.approx(0.250994, abs=1e-6)


def test_t_tests_and_cohens_d(survey):
    specs = [("Gender", "Age"), ("Gender", "Years_of_Experience"), ("GI_Aware", "Age"),
             ("GI_Aware", "Years_of_Experience"), ("Uses_Ecommerce", "Age"), ("Uses_Ecommerce", "Years_of_Experience")]
    exp = [(-0.926851, -0.105762), (-2.645729, -0.301901), (0.926925, 0.110910), (-1.550139, -0.185480),
           (0.506776, 0.064143), (-0.986086, -0.124809)]
    got = {(r["group_var"], r["value_var"]): r for r in S.t_tests(survey, specs).collect()}
    for spec, (t, d) in zip(specs, exp):
        assert got[spec]["t_statistic"] == pytest.approx(t, abs=1e-6)
        assert got[spec]["cohens_d"] == pytest.approx(d, abs=1e-6)


def test_anova(survey):
    got = {r["variable"]: r["f_statistic"] for r in S.anova(survey, "State", ["Age", "Years_of_Experience"]).collect()}
    assert got["Age"] == pytest.approx(0.255371, abs=1e-6)
    assert got["Years_of_Experience"] == pytest.approx(0.147163, abs=1e-6)


def test_correlations(survey):
    pm = {(r["var1"], r["var2"]): r["r"] for r in S.pearson_matrix(
        survey, ["Age", "Years_of_Experience", "GI_Aware_Binary", "Uses_Ecommerce_Binary", "Received_Subsidy_Binary"]).collect()}
    assert pm[("Age", "Years_of_Experience")] == pytest.approx(-0.111188, abs=1e-6)
    assert pm[("GI_Aware_Binary", "Uses_Ecommerce_Binary")] == pytest.approx(0.126599, abs=1e-6)
    assert pm[("GI_Aware_Binary", "Received_Subsidy_Binary")] == pytest.approx(-0.121026, abs=1e-6)
    assert pm[("Age", "Age")] == 1.0
    sp = {(r["var1"], r["var2"]): r["rho"] for r in S.spearman_matrix(survey, ["Age", "Years_of_Experience"]).collect()}
    assert sp[("Age", "Years_of_Experience")] == pytest.approx(-0.1099, abs=1e-4)
    kt = D.kendall_tau_b(survey, [("Age", "Years_of_Experience")], n_buckets=4).first()
    assert kt["tau_b"] == pytest.approx(-0.075945, abs=1e-6)
    pc = D.partial_correlation(survey, "GI_Aware_Binary", "Years_of_Experience", "Age").first()
    assert pc["partial_r"] == pytest.approx(0.081443, abs=1e-6)
    pc2 = D.partial_correlation(survey, "Uses_Ecommerce_Binary", "GI_Aware_Binary", "Age").first()
    assert pc2["partial_r"] == pytest.approx(0.125344, abs=1e-6)


def test_intervals_and_gap(survey):
    ci = {r["variable"]: r for r in S.proportion_ci(
        survey, ["GI_Aware_Binary", "Received_Subsidy_Binary", "Uses_Ecommerce_Binary"]).collect()}
    assert ci["GI_Aware_Binary"]["ci_lower"] == pytest.approx(0.626937, abs=1e-6)
    assert ci["GI_Aware_Binary"]["ci_upper"] == pytest.approx(0.729313, abs=1e-6)
    assert ci["Uses_Ecommerce_Binary"]["ci_lower"] == pytest.approx(0.217234, abs=1e-6)
    gap = S.rate_gap(survey, "Gender", "GI_Aware_Binary", "Male", "Female").first()
    assert gap["gap_pp"] == pytest.approx(6.77, abs=5e-3)


def test_kendall_brute_force_with_ties(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 120).astype(float)
    y = (x + rng.integers(0, 4, 120)).astype(float)
    x[:50] = 2.0                                  # a hot x value
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = D.kendall_tau_b(df, [("x", "y")], n_buckets=3).first()
    dx = np.sign(x[:, None] - x[None, :])
    dy = np.sign(y[:, None] - y[None, :])
    s = (dx * dy).sum() / 2
    n0 = len(x) * (len(x) - 1) / 2
    _, tx = np.unique(x, return_counts=True)
    _, ty = np.unique(y, return_counts=True)
    tau = s / np.sqrt((n0 - (tx * (tx - 1) / 2).sum()) * (n0 - (ty * (ty - 1) / 2).sum()))
    assert got["s"] == pytest.approx(s)
    assert got["tau_b"] == pytest.approx(tau, abs=1e-12)
