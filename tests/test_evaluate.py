"""Evaluation operators: the F5 golden and brute-force curve checks."""
import numpy as np
import pytest

from tabulon.operators import evaluate as V


def test_f5_golden(spark):
    rows = [(0.0, 1.0, 0.9)] * 21 + [(1.0, 1.0, 0.9)] * 43
    df = spark.createDataFrame(rows, "label double, prediction double, score double")
    m = V.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.671875)
    assert m["precision"] == pytest.approx(0.451416015625)
    assert m["recall"] == pytest.approx(0.671875)
    assert m["f1_score"] == pytest.approx(0.5400116822429907)
    cm = {(r["label"], r["prediction"]): r["count"] for r in V.confusion_counts(df).collect()}
    assert cm == {(0.0, 1.0): 21, (1.0, 1.0): 43}


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_auc_and_curves(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200).astype(float)
    s = np.round(rng.random(200) + 0.3 * y, 1)          # many tied scores
    df = spark.createDataFrame([(float(a), float(b), float(b > 0.6)) for a, b in zip(y, s)],
                               "label double, score double, prediction double")
    auc = V.roc_auc(df).first()[0]
    assert auc == pytest.approx(_brute_auc(y, s))
    roc = V.roc_curve(df).orderBy("point").collect()
    assert roc[0]["threshold"] == float("inf") and roc[0]["fpr"] == 0.0
    assert roc[-1]["fpr"] == 1.0 and roc[-1]["tpr"] == 1.0
    trap = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(roc, roc[1:]))
    assert trap == pytest.approx(auc)
    pr = V.precision_recall_curve(df).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)
    assert max(r["recall"] for r in pr) == 1.0


def test_model_comparison(spark):
    m = spark.createDataFrame([("a", 0, 0.8, 0.7, 0.9), ("b", 1, 0.8, 0.75, 0.85)],
                              "model string, model_order int, accuracy double, f1_score double, roc_auc double")
    assert V.best_model(m, "accuracy").first()["model"] == "a"          # tie → earlier model
    rec = {r["criterion"]: r["model"] for r in V.recommendations(m).collect()}
    assert rec == {"best_accuracy": "a", "best_f1": "b", "best_auc": "a", "best_balanced": "b"}
