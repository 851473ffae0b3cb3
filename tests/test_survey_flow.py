"""End-to-end survey flow: the column-count invariant 8 → 13 → 115 → 83 and the bin goldens (FIXTURES F1)."""
import os

import pytest
from pyspark.sql import functions as F

from tabulon.operators import select as SEL
from tabulon.plans import survey as SV
from tests.conftest import SURVEY_CSV


@pytest.fixture(scope="module")
def features(spark):
    if not os.path.exists(SURVEY_CSV):
        pytest.skip("survey CSV not available")
    raw = SV.load_and_validate(spark, SURVEY_CSV)
    cleaned = SV.clean_survey(raw, outliers=False).withColumn("is_outlier", F.lit(False))
    assert len(cleaned.columns) == 13
    return SV.create_survey_features(cleaned)


def test_column_counts(features):
    feat, model = features
    assert len(feat.columns) == 115
    assert len(model.stages[-1].getOrDefault("inputCols")) == 37
    cands = SEL.candidate_features(feat, SV.TARGET, SV.SELECTION_EXCLUDE)
    assert len(cands) == 88
    vt = SEL.variance_threshold(SEL.median_impute(feat, cands), cands)
    dropped = {r["feature"] for r in vt.where("not selected").collect()}
    assert dropped == {"Age_Experience_Ratio Experience_per_Age", "State_GI_Target_Encoded", "Gender_GI_Rate",
                       "Gender_Ecommerce_Rate", "Age_Group_GI_Rate"}


def test_bins_and_groups(features):
    feat, _ = features

    def counts(c):
        return [n for _, n in sorted((r[0], r[1]) for r in feat.groupBy(c).count().collect())]

    assert counts("Age_Bin_5") == [77, 59, 61, 56, 67]
    assert counts("Age_Quartiles") == [84, 79, 77, 80]
    assert counts("Experience_Quartiles") == [86, 88, 69, 77]
    groups = {r[0]: r[1] for r in feat.groupBy("Age_Group").count().collect()}
    assert groups == {"Young": 63, "Adult": 65, "Middle_Age": 69, "Senior": 63, "Elder": 60}
    assert feat.where("Late_Career_Start = 1").count() == 103
    assert feat.where("Career_Start_Age < 0").count() == 52


def test_new_rows_get_what_the_training_rows_taught(features):
    """A few rows alone get the features that they have in the whole table: nothing is learned from them."""
    feat, model = features
    raw = [*SV.REQUIRED, *[f"{c}_Binary" for c in (*SV.YES_NO, "Gender")], "is_outlier"]
    few = feat.where("Artisan_ID < 1005")
    out = {r["Artisan_ID"]: r for r in SV.transform_new_data(few.select(*raw), model).collect()}
    assert len(out) == 4
    for r in few.collect():
        for c in ("State_Encoded", "State_Frequency", "Age_Bin_5", "Age_Quartiles", "Age_scaled", "Gender_GI_Rate", "Late_Career_Start"):
            assert out[r["Artisan_ID"]][c] == pytest.approx(r[c]), c
