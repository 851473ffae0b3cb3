"""Fitted feature steps: state learned once, saved, applied to rows with unseen and missing values."""
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabulon.operators import fitted as FT
from tabulon.operators.dependence import correlation_frame
from tabulon.plans.ordering import global_positions
from tabulon.sources.files import ORDER_COL, read_csv

TRAIN = [("b", 1.0, 1), ("a", 2.0, 0), ("b", 3.0, 0), (None, 10.0, 1), ("c", 4.0, 1)]
NEW = [("a", 0.0, 0), ("zzz", 5.0, 0), (None, None, 0), ("c", 99.0, 0)]


@pytest.fixture(scope="module")
def frames(spark):
    schema = "s string, x double, y int"
    return spark.createDataFrame(TRAIN, schema), spark.createDataFrame(NEW, schema)


def stages():
    return [
        FT.derived({"twice": "x * 2"}),
        FT.LevelCodes(inputCol="s", outputCol="code"), FT.LevelDummies(inputCol="s", prefix="S"),
        FT.LevelStats(inputCol="s", outputCols=["target", "freq", "group_x"], statistics=["mean", "count", "max"], valueCols=["y", "", "x"],
                      unseen=["overall", "zero", "null"]),
        FT.LevelStats(inputCol="s", outputCols=["with_null"], statistics=["mean"], valueCols=["y"], unseen=["null"], nullLevel="nan"),
        FT.BinCodes(inputCol="x", outputCol="bin", bins=3), FT.BinCodes(inputCol="x", outputCol="half", bins=2, method="quantile"),
        FT.ScaleColumns(inputCols=["x", "twice"])]


def test_saved_state_is_applied_to_new_rows(spark, frames, tmp_path):
    train, new = frames
    model = Pipeline(stages=stages()).fit(train)
    FT.save_features(model, str(tmp_path / "m"))
    again = FT.load_features(str(tmp_path / "m"))
    got = {(r["s"], r["x"]): r.asDict() for r in again.transform(new).collect()}
    assert got == {(r["s"], r["x"]): r.asDict() for r in model.transform(new).collect()}
    a, z, n, c = got["a", 0.0], got["zzz", 5.0], got[None, None], got["c", 99.0]
    assert [r["code"] for r in (a, z, n, c)] == [0, -1, None, 2]
    assert [(r["S_a"], r["S_b"], r["S_c"]) for r in (a, z, n, c)] == [(True, False, False), (False,) * 3, (False,) * 3, (False, False, True)]
    assert [r["target"] for r in (a, z, n, c)] == [0.0, 0.6, None, 1.0]
    assert [r["freq"] for r in (a, z, n, c)] == [1, 0, None, 1]
    assert [r["group_x"] for r in (a, z, n, c)] == [2.0, None, None, 4.0]
    assert [r["with_null"] for r in (a, z, n, c)] == [0.0, None, 1.0, 1.0]
    assert [r["bin"] for r in (a, z, n, c)] == [0, 1, None, 2]         # edges 4 and 7 of the training range
    assert [r["half"] for r in (a, z, n, c)] == [0, 1, None, 1]        # median 3
    sd = (sum((v - 4.0) ** 2 for _, v, _ in TRAIN) / 5) ** 0.5
    assert [r["x_scaled"] for r in (a, z, n, c)] == pytest.approx([-4 / sd, 1 / sd, -1 / sd, 95 / sd])   # a missing x counts as 3


def test_nothing_is_learned_from_the_rows_transformed(frames):
    train, new = frames
    model = Pipeline(stages=stages()).fit(train)
    alone = {r["x"]: r.asDict() for r in model.transform(new.where("s = 'a'")).collect()}
    among = {r["x"]: r.asDict() for r in model.transform(new.unionByName(train)).where("s = 'a' AND x = 0").collect()}
    assert alone == among


def test_too_many_dummies_and_equal_edges_raise(spark, frames):
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="sparse vector"):
            FT.LevelDummies(inputCol="s", prefix="S").fit(frames[0])
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    same = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    with pytest.raises(ValueError, match="not unique"):
        FT.BinCodes(inputCol="x", outputCol="q", bins=4, method="quantile").fit(same)


def test_codes_of_many_levels(spark):
    df = spark.range(200_000).select(F.format_string("level %07d", F.col("id") % 100_000).alias("s"))
    out = FT.LevelCodes(inputCol="s", outputCol="code").fit(df).transform(df)
    assert out.where("code <> cast(substring(s, 7) as long)").count() == 0
    assert out.agg(F.max("code")).first()[0] == 99_999


def test_first_appearance_over_two_files(spark, tmp_path):
    """Codes follow file name and line, however the files are dealt to tasks."""
    for name, rows in (("a.csv", ["q", "p", "q"]), ("b.csv", ["z", "p", "a"] * 30)):
        (tmp_path / name).write_text("s,x\n" + "".join(f"{v},1\n" for v in rows))
    df = read_csv(spark, str(tmp_path), None, with_order=True)
    codes = {r["s"]: r["code"] for r in FT.LevelCodes(inputCol="s", outputCol="code", order=ORDER_COL).fit(df).transform(df).collect()}
    assert codes == {"q": 0, "p": 1, "z": 2, "a": 3}
    frame = correlation_frame(df, ["x"], [], {"same": ("x", "x")}, "s", ORDER_COL, "State_Code")
    assert frame.columns == ["x", "same", "State_Code"]
    assert {r["State_Code"]: r["count"] for r in frame.groupBy("State_Code").count().collect()} == {0.0: 2, 1.0: 31, 2.0: 30, 3.0: 30}


def test_positions_of_text_keys_with_ties(spark):
    df = spark.createDataFrame([(w, i) for i, w in enumerate("d b a c b b a".split())], "w string, i long").repartition(3)
    got = sorted((r["position"], r["w"], r["i"]) for r in global_positions(df, [F.col("w"), F.col("i")]).collect())
    assert [(w, i) for _, w, i in got] == sorted((w, i) for i, w in enumerate("d b a c b b a".split()))
    assert [p for p, _, _ in got] == list(range(7))
