"""Published survey goldens on tables rebuilt from their published counts (no file needed)."""
import pytest

from tabulon.operators import models as M
from tabulon.operators import report as R
from tabulon.operators import stats as S

# Yes answers and rows by state; rows and Yes answers by gender follow from the published rates.
STATE_YES = {"Arunachal Pradesh": (29, 43), "Assam": (23, 35), "Manipur": (26, 37), "Meghalaya": (33, 48),
             "Mizoram": (26, 35), "Nagaland": (22, 38), "Sikkim": (30, 46), "Tripura": (28, 38)}
GENDER_YES = {"Female": (125, 192), "Male": (92, 128)}


@pytest.fixture(scope="module")
def by_state(spark):
    return spark.createDataFrame([(k, "Yes" if i < yes else "No") for k, (yes, n) in STATE_YES.items() for i in range(n)],
                                 "State string, GI_Aware string")


@pytest.fixture(scope="module")
def by_gender(spark):
    return spark.createDataFrame([(k, "Yes" if i < yes else "No") for k, (yes, n) in GENDER_YES.items() for i in range(n)],
                                 "Gender string, GI_Aware string")


def test_chi_square_and_cramers_v(by_state, by_gender):
    s = S.with_chi2_pvalues(S.chi_square_tests(by_state, [("State", "GI_Aware")])).first()
    assert (s["chi2"], s["dof"], s["cramers_v"]) == (pytest.approx(3.321527, abs=1e-6), 7, pytest.approx(0.101881, abs=1e-6))
    g = S.with_chi2_pvalues(S.chi_square_tests(by_gender, [("Gender", "GI_Aware")])).first()
    assert (g["chi2"], g["dof"], g["cramers_v"]) == (pytest.approx(1.317764, abs=1e-6), 1, pytest.approx(0.064172, abs=1e-6))
    assert g["p_value"] == pytest.approx(0.250994, abs=1e-6)


def test_proportion_interval(spark):
    for yes, low, high in ((217, 0.626937, 0.729313), (110, 0.291711, 0.395789), (85, 0.217234, 0.314016)):
        df = spark.createDataFrame([(int(i < yes),) for i in range(320)], "y int")
        r = S.proportion_ci(df, ["y"]).first()
        assert (r["ci_lower"], r["ci_upper"]) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6))


def test_state_rates(by_state):
    got = {r["State"]: r["GI_Aware"] for r in R.group_profile(by_state, "State", yes_cols=["GI_Aware"]).collect()}
    assert got["Assam"] == pytest.approx(round(23 / 35 * 100, 2)) and got["Mizoram"] == pytest.approx(round(26 / 35 * 100, 2))


def test_split_of_the_survey_has_64_test_rows():
    assert M.test_sizes({"No": 103, "Yes": 217}, 0.2) == {"No": 21, "Yes": 43}
