"""The survey analysis flow composed from the operators.

Everything is lazy DataFrame composition; the only driver round-trips are
bounded metadata (bin edges, category levels, scaler parameters, model
parameters).  The cleaned table and the feature table are cut from their
lineage with ``checkpoint()`` into the shared checkpoint folder, because
each is reused by many downstream jobs.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tabulon.operators import clean as C
from tabulon.operators import features as X
from tabulon.operators import fitted as FT
from tabulon.operators import quality as Q
from tabulon.operators import report as R
from tabulon.operators import stats as S
from tabulon.session import cut_lineage
from tabulon.sources.files import ORDER_COL, read_survey

# ---- fixed values of the survey analysis (must equal the reference's) -----------------
REQUIRED = ["State", "Artisan_ID", "Gender", "GI_Aware", "Received_Subsidy", "Uses_Ecommerce", "Age",
            "Years_of_Experience"]
YES_NO = ["GI_Aware", "Received_Subsidy", "Uses_Ecommerce"]
GENDERS = ["Male", "Female"]
CATEGORIES = ["State", "Gender", "GI_Aware", "Received_Subsidy", "Uses_Ecommerce"]
BINARY = {"GI_Aware": "Yes", "Received_Subsidy": "Yes", "Uses_Ecommerce": "Yes", "Gender": "Male"}
AGE_EDGES = [0, 25, 35, 45, 55, 100]
AGE_LABELS = ["Young", "Adult", "Middle_Age", "Senior", "Elder"]
EXP_EDGES = [0, 5, 15, 25, 50]
EXP_LABELS = ["Novice", "Intermediate", "Experienced", "Expert"]
POLY_COLS = ["Age", "Years_of_Experience", "Age_Experience_Ratio", "Experience_per_Age"]
INTERACTIONS = {
    "Age_Male_Interaction": ("Age", "Gender_Binary"),
    "Experience_Male_Interaction": ("Years_of_Experience", "Gender_Binary"),
    "GI_Age_Interaction": ("GI_Aware_Binary", "Age"),
    "GI_Experience_Interaction": ("GI_Aware_Binary", "Years_of_Experience"),
    "GI_Gender_Interaction": ("GI_Aware_Binary", "Gender_Binary"),
    "Subsidy_Age_Interaction": ("Received_Subsidy_Binary", "Age"),
    "Subsidy_Experience_Interaction": ("Received_Subsidy_Binary", "Years_of_Experience"),
    "Ecommerce_Age_Interaction": ("Uses_Ecommerce_Binary", "Age"),
    "Ecommerce_Gender_Interaction": ("Uses_Ecommerce_Binary", "Gender_Binary"),
}
CHI2_PAIRS = [("Gender", "GI_Aware"), ("State", "GI_Aware"), ("Gender", "Uses_Ecommerce"),
              ("State", "Uses_Ecommerce"), ("GI_Aware", "Received_Subsidy"), ("Uses_Ecommerce", "Received_Subsidy")]
TTEST_PAIRS = [("Gender", "Age"), ("Gender", "Years_of_Experience"), ("GI_Aware", "Age"),
               ("GI_Aware", "Years_of_Experience"), ("Uses_Ecommerce", "Age"), ("Uses_Ecommerce", "Years_of_Experience")]
CORR_COLS = ["Age", "Years_of_Experience", "GI_Aware_Binary", "Received_Subsidy_Binary", "Uses_Ecommerce_Binary"]
SELECTION_EXCLUDE = ["Artisan_ID", "State", "Gender", "GI_Aware", "Received_Subsidy", "Uses_Ecommerce", "Age_Group",
                     "Experience_Group"]
TARGET = "GI_Aware_Binary"
# name fragments of columns built from the target (used by the optional leakage guard)
TARGET_DERIVED = ["GI_", "Target_Encoded", "Awareness_Support", "Engagement_Score"]
PRIORITY_RULES = [
    ("gi_awareness_rate", "<", 70.0, "Increase GI awareness programs"),
    ("ecommerce_adoption_rate", "<", 30.0, "Promote digital marketplace adoption"),
    ("gender_gap", ">", 10.0, "Address the gender gap in GI awareness"),
]


# ---------------------------------------------------------------- load + validate (#1, #9–#13)
def load_and_validate(spark: SparkSession, path: str) -> DataFrame:
    df = read_survey(spark, path)
    Q.require_columns(df, REQUIRED)
    Q.require_rows(df)
    return df


def validation_report(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "duplicate_ids": Q.duplicate_key_count(df, "Artisan_ID"),
        "range": Q.range_violations(df, {"Age": (0, 120), "Years_of_Experience": (0, None)}),
        "domain": Q.domain_violations(df, {**{c: ["Yes", "No"] for c in YES_NO}, "Gender": GENDERS}),
    }


# ---------------------------------------------------------------- clean (#21)
def clean_survey(df: DataFrame, outliers: bool = True) -> DataFrame:
    out = C.clean_data(df, id_col="Artisan_ID", order=[ORDER_COL], categories=CATEGORIES, binary=BINARY,
                       numeric=("Age", "Years_of_Experience"), outlier_flag="is_outlier" if outliers else None,
                       outlier_kwargs={"key": "Artisan_ID"})
    return out


# ---------------------------------------------------------------- statistics (entry B)
def survey_statistics(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "numeric": S.describe_numeric(df, ["Age", "Years_of_Experience"]),
        "categorical": S.describe_categorical(df, ["State", "Gender", *YES_NO]),
        "chi_square": S.with_chi2_pvalues(S.chi_square_tests(df, CHI2_PAIRS)),
        "pearson": S.pearson_matrix(df, CORR_COLS),
        "spearman": S.spearman_matrix(df, CORR_COLS),
        "significant": S.significant_correlations(df, CORR_COLS),
        "t_tests": S.with_t_pvalues(S.t_tests(df, TTEST_PAIRS)),
        "anova": S.with_f_pvalues(S.anova(df, "State", ["Age", "Years_of_Experience"])),
        "gender_gap": S.rate_gap(df, "Gender", "GI_Aware_Binary", "Male", "Female"),
        "ecommerce_gi": S.binary_correlation(df, "Uses_Ecommerce_Binary", "GI_Aware_Binary"),
        "proportion_ci": S.proportion_ci(df, ["GI_Aware_Binary", "Received_Subsidy_Binary", "Uses_Ecommerce_Binary"]),
        "mean_ci": S.mean_ci(df, ["Age", "Years_of_Experience"]),
    }


# ---------------------------------------------------------------- features (#57–#73)
def survey_feature_stages() -> list:
    """All feature families in the reference's order, as pipeline stages; the fitted ones learn levels, means, frequencies,
    edges and scales."""
    return [
        # derived (#59–#62)
        FT.derived({
            "Age_Group": FT.label_sql("Age", AGE_EDGES, AGE_LABELS),
            "Experience_Group": FT.label_sql("Years_of_Experience", EXP_EDGES, EXP_LABELS),
            "Age_Experience_Ratio": "try_divide(CAST(Age AS DOUBLE), CAST(Years_of_Experience + 1 AS DOUBLE))",
            "Experience_per_Age": "try_divide(CAST(Years_of_Experience AS DOUBLE), CAST(Age AS DOUBLE))",
            "Career_Start_Age": "Age - Years_of_Experience",
            "Late_Career_Start": "CAST(Age - Years_of_Experience > 30 AS INT)",
            "Digital_Adoption_Score": "CAST(Uses_Ecommerce_Binary AS INT) * 2 + CAST(Age < 40 AS INT)",
            "Awareness_Support_Score": "CAST(GI_Aware_Binary AS INT) * 2 + CAST(Received_Subsidy_Binary AS INT)",
            "Engagement_Score": "CAST(GI_Aware_Binary AS INT) + CAST(Uses_Ecommerce_Binary AS INT) + CAST(Received_Subsidy_Binary AS INT)"}),
        # encodings (#63–#66) and the State half of the aggregates (#72), which share a table
        FT.LevelDummies(inputCol="State", prefix="State"),
        FT.LevelCodes(inputCol="State", outputCol="State_Encoded"),
        FT.LevelStats(inputCol="State", outputCols=["State_GI_Target_Encoded", "State_Frequency", "State_Avg_Age", "State_Avg_Experience"],
                      statistics=["mean", "count", "mean", "mean"], valueCols=["GI_Aware_Binary", "", "Age", "Years_of_Experience"],
                      unseen=["overall", "zero", "null", "null"]),
        FT.derived({**FT.dummy_sql("Age_Group", "Age_Group", AGE_LABELS), **FT.dummy_sql("Experience_Group", "Exp_Group", EXP_LABELS),
                    # polynomial + interactions (#67, #68)
                    **FT.polynomial_sql(POLY_COLS, 2), **{n: f"`{a}` * `{b}`" for n, (a, b) in INTERACTIONS.items()}}),
        FT.CutLineageStage(),
        # binned (#69–#71)
        *[FT.BinCodes(inputCol=c, outputCol=f"{short}_Bin_{n}", bins=n)
          for c, short in (("Age", "Age"), ("Years_of_Experience", "Experience")) for n in (5, 10)],
        FT.BinCodes(inputCol="Age", outputCol="Age_Quartiles", bins=4, method="quantile"),
        FT.BinCodes(inputCol="Years_of_Experience", outputCol="Experience_Quartiles", bins=4, method="quantile"),
        FT.derived({"Young_Artisan": "CAST(Age <= 30 AS INT)", "Senior_Artisan": "CAST(Age >= 50 AS INT)",
                    "Novice_Artisan": "CAST(Years_of_Experience <= 5 AS INT)", "Expert_Artisan": "CAST(Years_of_Experience >= 20 AS INT)",
                    "Age_Deviation_from_State": "Age - State_Avg_Age",
                    "Experience_Deviation_from_State": "Years_of_Experience - State_Avg_Experience"}),
        # aggregated (#72); a missing Age_Group forms its own group, as in the reference
        FT.LevelStats(inputCol="Gender", outputCols=["Gender_GI_Rate", "Gender_Ecommerce_Rate"], statistics=["mean", "mean"],
                      valueCols=["GI_Aware_Binary", "Uses_Ecommerce_Binary"], unseen=["null", "null"]),
        FT.LevelStats(inputCol="Age_Group", outputCols=["Age_Group_GI_Rate"], statistics=["mean"], valueCols=["GI_Aware_Binary"],
                      unseen=["null"], nullLevel="nan"),
        FT.CutLineageStage(),
        # scaling (#73)
        FT.ScaleColumns()]


def survey_types(df: DataFrame) -> DataFrame:
    """Column types that the stages expect (#58), without the file order."""
    f = df.drop(ORDER_COL) if ORDER_COL in df.columns else df
    return X.coerce_types(f, categorical=["State", "Gender"], numeric=["Age", "Years_of_Experience"], numeric_type="bigint")


def create_survey_features(df: DataFrame) -> tuple[DataFrame, PipelineModel]:
    """The feature table and the fitted pipeline that made it."""
    rows = cut_lineage(survey_types(df))
    model = Pipeline(stages=survey_feature_stages()).fit(rows)
    return cut_lineage(model.transform(rows)), model


def transform_new_data(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Features of new rows from what was learned on the training rows: nothing is fitted again."""
    return model.transform(survey_types(df))


def customer_feature_stages() -> list:
    """The same feature families on a customer table (used by the registered queries)."""
    return [
        FT.derived({"Balance_Group": FT.label_sql("c_acctbal", [-1000, 0, 2500, 5000, 10000], ["Negative", "Low", "Mid", "High"]),
                    "Balance_Ratio": "try_divide(c_acctbal, 1000.0D)"}),
        FT.derived(FT.dummy_sql("Balance_Group", "Balance_Group", ["Negative", "Low", "Mid", "High"])),
        FT.LevelCodes(inputCol="n_name", outputCol="Nation_Encoded"),
        FT.LevelStats(inputCol="n_name", outputCols=["Nation_Target_Encoded", "Nation_Frequency", "Nation_Avg_Balance"],
                      statistics=["mean", "count", "mean"], valueCols=["positive_balance", "", "c_acctbal"], unseen=["overall", "zero", "null"]),
        FT.derived({**FT.polynomial_sql(["c_acctbal", "Balance_Ratio"], 2), "Balance_Deviation": "c_acctbal - Nation_Avg_Balance"}),
        FT.BinCodes(inputCol="c_acctbal", outputCol="Balance_Bin_5", bins=5),
        FT.BinCodes(inputCol="c_acctbal", outputCol="Balance_Quartiles", bins=4, method="quantile"),
        FT.ScaleColumns(inputCols=["c_acctbal", "Balance_Ratio", "c_acctbal^2", "Nation_Avg_Balance", "Balance_Deviation"])]


def numeric_feature_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


# ---------------------------------------------------------------- impact + summary (#104, #105, #8)
def impact(df: DataFrame) -> DataFrame:
    return R.impact_metrics(df, {"gi_awareness_rate": "GI_Aware", "ecommerce_adoption_rate": "Uses_Ecommerce",
                                 "subsidy_coverage": "Received_Subsidy"})


def priorities(df: DataFrame) -> DataFrame:
    return R.priority_areas(impact(df), PRIORITY_RULES)


def executive_summary(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(section, name, value) rows: impact metrics plus the best model by accuracy and F1."""
    imp = impact(df)
    rows = imp.unpivot([], imp.columns, "name", "value").select(F.lit("impact").alias("section"), "name",
                                                                F.col("value").cast("double").alias("value"))
    if metrics is not None:
        from tabulon.operators.evaluate import best_model
        for m in ("accuracy", "f1_score"):
            rows = rows.unionByName(best_model(metrics, m).select(F.lit(f"best_{m}").alias("section"),
                                                                  F.col("model").alias("name"),
                                                                  F.col(m).cast("double").alias("value")))
    return rows
